"""Substring dedup by compacted paths of repeated token k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import id_and_text, slices

#: Words of a window (an edge of the graph), and of an anchor, the gram of least hash in a window.
WINDOW, ANCHOR = 13, 5
#: Bytes of texts, compressed but for the first use, that a task handles at once.
SLICE = 1 << 20
#: Word hashes that a worker remembers; beyond it starts anew.
REMEMBERED = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Hashes(dict):
    """XXH64 of each word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


HASHES = Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, equal on all machines."""
    if len(HASHES) > REMEMBERED:
        HASHES.clear()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


class Run:
    """The words of several texts, end to end: their hashes, and the places where a window lies within one text."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.hashes = word_hashes([w for words in split for w in words])
        self.begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        n = max(0, len(self.hashes) - window + 1)
        self.at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.zeros(0, np.int64)
        self.owner = owner[self.at]
        self.anchors = window_anchors(self.hashes, window, anchor)[self.at]
        self.ends = (self.begins + sizes)[self.owner] if n else self.at


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out = (out ^ hashes[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(32)
    return out


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window the hash of its anchor. Equal windows have equal anchors, and neighbouring windows mostly share theirs."""
    grams = gram_hashes(hashes, anchor)
    n = max(0, len(hashes) - window + 1)
    out = grams[:n].copy()
    for j in range(1, window - anchor + 1 if n else 0):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """One key for a row's id and text; rows that agree in both are one source. Where two other rows' keys agree, they share what is
    asked and told of either, and the digests say what holds for which."""
    return F.xxhash64(doc_id, F.xxhash64(text), F.lit(7))


def _grouped(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A whole partition of a few long columns: a task's share of the anchors or edges, all rows of one of them included."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(key, anchor) for anchors (anchor, key) that occur in two rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _grouped(batches)
        if table is None:
            return
        anchors, keys = (table.column(k).to_numpy() for k in range(2))
        order = np.argsort(anchors, kind="stable")
        anchors, keys = anchors[order], keys[order]
        starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        several = np.minimum.reduceat(keys, starts) != np.maximum.reduceat(keys, starts)
        keep = np.repeat(several, np.diff(np.r_[starts, len(keys)]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(anchors[keep])], names=["key", "anchor"])

    return rows.repartition("anchor").mapInArrow(run, "key long, anchor long")


def covered_windows(edges: DataFrame) -> DataFrame:
    """(key, pos, src_key, src_pos, joint) for each window that also starts in a document of a smaller id, with the place of its first occurrence.

    joint is false if the edge branches: if its occurrences differ in the word before or the word behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _grouped(batches)
        if table is None:
            return
        edge, ids, keys, pos, around = (table.column(k).to_numpy() for k in range(5))
        order = np.lexsort((pos, keys, ids, edge))
        edge, ids, keys, pos, around = edge[order], ids[order], keys[order], pos[order], around[order]
        starts = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(edge)]))
        joint = np.minimum.reduceat(around, starts) == np.maximum.reduceat(around, starts)
        first = starts[of]
        keep = ids > ids[first]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (keys, pos, keys[first], pos[first], joint[of])], names=["key", "pos", "src_key", "src_pos", "joint"])

    return edges.repartition("edge").mapInArrow(run, "key long, pos int, src_key long, src_pos int, joint boolean")


def paths(covered: DataFrame, window: int) -> DataFrame:
    """Compacts runs of edges that follow each other both in the row and in the source, up to a branching edge, into (key, start, n, src_key, src_start), in words."""
    covered = covered.withColumn("shift", F.col("pos") - F.col("src_pos"))
    run = W.partitionBy("key", "src_key", "shift").orderBy("pos")
    before = F.lag("pos").over(run)
    breaks = before.isNull() | (before != F.col("pos") - 1) | ~(F.col("joint") & F.lag("joint").over(run))
    numbered = covered.withColumn("fresh", breaks.cast("int")).withColumn("path", F.sum("fresh").over(run))
    spans = numbered.groupBy("key", "src_key", "shift", "path").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    return spans.select("key", "start", (F.col("stop") - F.col("start") + window).alias("n"), "src_key", (F.col("start") - F.col("shift")).alias("src_start"))


def substring_dedup(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: its words, how many of them are removed, and the digest of those that stay (and `kept_text` if asked).

    A word is removed if a window of `window` words that covers it also starts in a row of a smaller id. Windows are edges
    of a De Bruijn graph over the words. Exact copies are found by their digest and keep nothing that a window covers. Of
    the other texts, each window's anchor is grouped first, so that only windows whose anchor two rows share become edges;
    the rows of an edge give its first place and whether it branches; unbranched runs are compacted to paths; the digest of
    a path's words is compared with that of the words at its source before any is removed. The window is judged on the
    input. Null and empty texts have no words; a null id is larger than every other; rows of equal id don't remove each
    other's words; an empty table gives no rows.
    """
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    texts = id_and_text(df, id_col, text_col)
    texts = texts.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("sha"), F.col("text").cast("binary").alias("text"))
    # Keys alone could agree by chance in a large table; with a part of the text's digest they tell rows apart.
    texts = texts.withColumn("tag", F.xxhash64("sha"))
    firsts = texts.groupBy("sha").agg(F.min(order).alias("first"))
    # Ids and digests alone: which rows are the first of their text, by row.
    roles = texts.select("key", "tag", "sha", order.alias("ord")).distinct().join(firsts, "sha").select(F.col("key").alias("role_key"), F.col("tag").alias("role_tag"), F.col("ord").alias("role_ord"), (F.col("ord") > F.col("first")).alias("copy")).hint("shuffle_hash")
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, most_bytes=SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([compress(x) for x in batch.column(2).to_pylist()], pa.binary()), batch.column(3)], names=["doc_id", "key", "text", "tag"])

    # Every use below takes the same columns and is joined on the key alone, so that all share one shuffle of the texts. What
    # else tells rows apart is compared as bits, as further join keys would deal the rows anew.
    zero = F.lit(0).cast("long")
    itself = (F.col("key") == F.col("role_key")) & (F.col("tag").bitwiseXOR(F.col("role_tag")) == zero) & (order.bitwiseXOR(F.col("role_ord")) == zero)
    rows = texts.select("doc_id", "key", "text", "tag").mapInArrow(shrink, "doc_id long, key long, text binary, tag long").join(roles, itself).drop("role_key", "role_tag", "role_ord", "tag")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE):
            run = Run(texts_of(batch), window, anchor)
            keys = batch.column(1).to_numpy()[run.owner]
            # Neighbouring windows mostly share an anchor; a row for each change is enough.
            fresh = np.r_[True, (run.anchors[1:] != run.anchors[:-1]) | (run.owner[1:] != run.owner[:-1])][: len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(run.anchors[fresh].view(np.int64)), pa.array(keys[fresh])], names=["anchor", "key"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE):
            run = Run(texts_of(batch), window, anchor)
            shared = batch.column(3)
            sizes = np.asarray(pc.list_value_length(shared).to_numpy(zero_copy_only=False), np.int64)
            mine = np.repeat(np.arange(batch.num_rows), sizes)
            salt = lambda owner, x: (x ^ (owner.astype(np.uint64) * MIX)) * MIX
            known = np.sort(salt(mine, shared.flatten().to_numpy().view(np.uint64)))
            asked = salt(run.owner, run.anchors)
            place = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
            hit = known[place] == asked if len(known) else np.zeros(len(asked), bool)
            at, owner, ends = run.at[hit], run.owner[hit], run.ends[hit]
            sums = gram_hashes(run.hashes, window)[at] if len(at) else np.zeros(0, np.uint64)
            # A text's first place of an edge stands for all; the others are found again in the end.
            _, first = np.unique(salt(owner, sums), return_index=True)
            first.sort()
            at, owner, ends, sums = at[first], owner[first], ends[first], sums[first]
            top = run.hashes >> np.uint64(48)
            before = np.where(at > run.begins[owner], top[np.maximum(at - 1, 0)], 0) if len(at) else at
            behind = np.where(at + window < ends, top[np.minimum(at + window, len(top) - 1)], 0) if len(at) else at
            around = (before.astype(np.int64) << 16 | behind.astype(np.int64)).astype(np.uint32).view(np.int32)
            ids = pc.fill_null(batch.column(0), 2**63 - 1).to_numpy()
            arrays = [sums.view(np.int64), ids[owner], batch.column(1).to_numpy()[owner], (at - run.begins[owner]).astype(np.int32), around]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["edge", "ord", "key", "pos", "around"])

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE):
            out = [[], [], [], []]
            for key, text, spans in zip(batch.column(1).to_pylist(), texts_of(batch), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                for s in spans:
                    for c, x in zip(out, (key, s["src_start"], s["n"], span_digest(words, s["src_start"], s["n"])), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["src_key", "src_start", "n", "digest"])

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE):
            out = [[], [], [], []]
            for copy, text, spans in zip(batch.column(3).to_pylist(), texts_of(batch), batch.column(4).to_pylist(), strict=True):
                words = text.split()
                total, kept = len(words), words
                if copy and total >= window:
                    kept = []
                elif spans and total >= window:
                    covered = np.zeros(total - window + 1, bool)
                    for s in spans:
                        if s["digest"] == span_digest(words, s["start"], s["n"]):
                            covered[s["start"] : s["start"] + s["n"] - window + 1] = True
                    sums = gram_hashes(word_hashes(words), window)
                    at = np.flatnonzero(np.isin(sums, sums[covered]))
                    steps = np.bincount(at, minlength=total + 1) - np.bincount(at + window, minlength=total + 1)
                    stays = np.cumsum(steps)[:total] == 0
                    kept = [w for w, stay in zip(words, stays.tolist(), strict=True) if stay]
                joined = b" ".join(kept)
                for c, x in zip(out, (total, total - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None), strict=True):
                    c.append(x)
            arrays = [batch.column(0).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[3], pa.string())] if with_text else arrays, names=[*names, "kept_text"] if with_text else names)

    own = rows.where("not copy")
    shared = repeated_anchors(own.select("doc_id", "key", "text").mapInArrow(anchors, "anchor long, key long"))
    shared = shared.groupBy("key").agg(F.collect_set("anchor").alias("anchors")).withColumnRenamed("key", "its").hint("shuffle_hash")
    found = own.join(shared, F.col("key") == F.col("its")).select("doc_id", "key", "text", "anchors").mapInArrow(edges, "edge long, ord long, key long, pos int, around int")
    spans = paths(covered_windows(found), window)
    wanted = spans.select("src_key", "src_start", "n").distinct().groupBy("src_key").agg(F.collect_list(F.struct("src_start", "n")).alias("spans")).hint("shuffle_hash")
    digests = own.join(wanted, F.col("key") == F.col("src_key")).select("doc_id", "key", "text", "spans").mapInArrow(sources, "src_key long, src_start int, n int, digest binary").dropDuplicates(["src_key", "src_start", "n", "digest"])
    checked = spans.join(digests, ["src_key", "src_start", "n"]).groupBy("key").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans")).withColumnRenamed("key", "its").hint("shuffle_hash")
    final = rows.join(checked, F.col("key") == F.col("its"), "left").select("doc_id", "key", "text", "copy", "spans")
    return final.mapInArrow(result, SCHEMA + (", kept_text string" if with_text else ""))


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts, which go through the shuffle compressed."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in batch.column(2).to_pylist()]


def span_digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()

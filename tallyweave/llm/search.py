"""Ranked lexical search, reversed: texts stream through an index of the items' terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import id_and_text, slices, written

TOP = 20
#: Bytes of items' texts of a block. An index holds one block, and every block makes one pass over the texts.
ITEM_BYTES = 8 << 20
#: Bytes of a text that are cut into terms at once, and cells (texts by items, or matches) that are added up at once.
PIECE, CELLS = 1 << 20, 1 << 22
#: Heaps of one item that meet in a task of the first merge are a share of so many.
MERGES = 64
#: Bytes of a term: letters and digits (A-Z become small), and all that UTF-8 has beyond ASCII; the others become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TABLE = "doc_id long, n long, terms array<int>, counts array<int>"
HEAPS = "item int, item_id long, doc_id long, score long, part int"


def term_counts(data: bytes) -> tuple[int, Counter]:
    """The number of a text's terms, and each term's count. Long texts are cut at blanks, so that few terms are objects at once."""
    data, counts, n, at = data.translate(TERM_BYTES), Counter(), 0, 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        counts.update(words)
        n, at = n + len(words), end
    return n, counts


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Runs of items (id, text) of about `most_bytes`; the driver holds one run at a time. Repeated rows are one item."""
    block, size = [], 0
    for row in items.distinct().orderBy("doc_id", "text").toLocalIterator():
        text = row.text.encode()
        if block and size + len(text) > most_bytes:
            yield block
            block, size = [], 0
        block.append((row.doc_id, text))
        size += len(text)
    if block:
        yield block


def _matched(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """The number of terms of each text, and its counts of the terms of the index, written where all executors read it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the terms of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n, found = term_counts(text)
                sizes.append(n)
                for term in found.keys() & known.keys():
                    terms.append(known[term])
                    counts.append(found[term])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return written(docs.mapInArrow(run, TABLE))


class Heaps:
    """The best texts of each item so far: by score, then by id, a null id last."""

    def __init__(self, n_items: int, top: int):
        self.n_items, self.top = n_items, top
        self.item, self.score, self.id, self.none = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.ones(n_items, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """`scores` has a row for each text and a column for each item."""
        least = self.least
        if len(scores) > self.top:  # a text under a column's own best ones can't be among them all
            least = np.maximum(least, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        item = np.r_[self.item, item]
        score, id_, null = np.r_[self.score, scores[row, item[len(self.item) :]]], np.r_[self.id, ids[row]], np.r_[self.none, none[row]]
        order = np.lexsort((id_, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.top]
        self.item, self.score, self.id, self.none = item[rank < self.top], score[order], id_[order], null[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=self.n_items) == self.top)
        self.least[full] = self.score[np.searchsorted(self.item, full, "right") - 1]


def _streamed(table: DataFrame, ids: list[int | None], index: tuple[np.ndarray, np.ndarray, np.ndarray], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Each task's heaps: every text's counts go through the index once, in order."""
    shared = table.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, item, weight = shared.value
        heaps, n_items = Heaps(len(ids), top), len(ids)

        def add(id_: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
            # A text's length enters by whole numbers of any size.
            length = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            part = 1_000_000_000 * counts // (1000 * counts + 12 * length[doc])
            places = starts[terms + 1] - starts[terms]
            at = np.repeat(starts[terms] - np.cumsum(places) + places, places) + np.arange(places.sum())
            scores = np.zeros(len(n) * n_items, np.int64)
            np.add.at(scores, np.repeat(doc * n_items, places) + item[at], np.repeat(part, places) * weight[at])
            heaps.offer(scores.reshape(len(n), n_items), id_.fill_null(0).to_numpy(zero_copy_only=False), id_.is_null().to_numpy(zero_copy_only=False).astype(np.int64))

        for batch in batches:
            n, terms, counts = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            ends = terms.offsets.to_numpy().astype(np.int64)
            terms, counts = terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            work = np.r_[0, np.cumsum(starts[terms + 1] - starts[terms])]
            first = 0
            while first < len(n):
                # As many texts as keep both the matches and the table of scores within bounds, one at least.
                last = int(np.searchsorted(work[ends], work[ends[first]] + CELLS, "right")) - 1
                last = min(max(last, first + 1), first + max(1, CELLS // n_items), len(n))
                a, b = ends[first], ends[last]
                add(batch.column(0).slice(first, last - first), n[first:last], ends[first : last + 1] - a, terms[a:b], counts[a:b])
                first = last
        none = heaps.none.astype(bool)
        found = [pa.array(heaps.item, pa.int32()), pa.array([ids[i] for i in heaps.item.tolist()], pa.int64()), pa.array(heaps.id, pa.int64(), mask=none), pa.array(heaps.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(found, names=["item", "item_id", "doc_id", "score"])

    return table.mapInArrow(run, HEAPS.rpartition(",")[0]).withColumn("part", F.spark_partition_id() % MERGES)


def _best(heaps: DataFrame, top: int, *keys: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def reversed_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row (item_id, rank, doc_id, score) for each of an item's `top` best texts, the best first, equal scores by id.

    The items are the index: their terms are held in every task, in blocks of bounded bytes. A first pass counts each
    text's terms and keeps the counts of those that the index has, which also tells in how many texts a term is, and how
    long texts are. A second streams these counts through the index, adding a term's share to all its items at once, and
    keeps a heap of `top` texts an item in each task; heaps are merged twice, first by item and a share of the tasks. No
    text is shuffled. Null and empty texts have no terms and no row, and neither has an item without terms; a null id comes
    behind all others of its score; repeated texts are ranked one by one, repeated items are one item, and texts under one
    item id are ranked each on its own; empty tables give no rows; other columns aren't read, whatever their names.
    """
    rows, results = id_and_text(docs, id_col, text_col), []
    for block in item_blocks(id_and_text(items, item_id_col, item_text_col), item_bytes):
        counts = [term_counts(text)[1] for _, text in block]
        index = {term: i for i, term in enumerate(sorted(set().union(*counts)))}
        table = _matched(rows, index)
        n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_terms:
            continue
        # One row for each term of the index.
        held = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(index))]
        places = sorted((index[term], item, n * weights[index[term]]) for item, found in enumerate(counts) for term, n in found.items())
        starts = np.searchsorted(np.array([p[0] for p in places], np.int64), np.arange(len(index) + 1))
        by_term = starts, np.array([p[1] for p in places], np.int64), np.array([p[2] for p in places], np.int64)
        heaps = _streamed(table, [id_ for id_, _ in block], by_term, n_docs, n_terms, top)
        results.append(_best(_best(heaps, top, "item", "part"), top, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out

"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed, heavy_keys, id_and_text, id_key, nested, slices, spread_join, with_sizes
from tallyweave.llm.components import smallest_of_each

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
#: Segments of the ring. More of them make longer keys (28 of 64 bits at 16 segments and two differing bits), so that fewer
#: fingerprints meet by chance, and one key more for each.
SEGMENTS = 16
#: Rows of a bucket that meet in one block; a larger bucket is dealt out as pairs of blocks.
BLOCK = 1024


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, of the whole sequence if it is shorter."""
    import xxhash

    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(text, SEED)], ">u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = np.r_[0, ends[:-1]][: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(text[a:b], SEED) for a, b in zip(first, last, strict=True)], ">u8")


def majority(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The majority of the hashes of the shingles, repeats included; 0 without words."""
    return int.from_bytes(majority(shingle_hashes(words, shingle)), "big") if words else 0


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed long. Row by row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(x.lower().split(), shingle) for x in batch.column(1).to_pylist()]  # of bytes: A-Z, and \x20 and \x09-\x0D, alone
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ring_masks(distance: int, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(mask, most) for each budget of a chain that starts at bit 0: of the first so many segments at most `most` bits may differ.

    A chain of k segments may hold distance * k / segments differences. As sums only grow, the longest chain of each whole
    number of differences stands for the shorter ones.
    """
    width = BITS // segments
    longest = {distance * k // segments: k for k in range(1, segments + 1)}
    return [((1 << width * k) - 1, most) for most, k in sorted(longest.items())]


def rotated(fps: np.ndarray, by: int) -> np.ndarray:
    return fps if by == 0 else (fps >> np.uint64(by)) | (fps << np.uint64(BITS - by))


def linked(fps: np.ndarray, start: int, masks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that join all fingerprints of a block that hang together by links whose chain starts at bit `start`; one fewer than nodes at most."""
    root, edges, turned = np.arange(len(fps)), [], rotated(fps, start)
    for i in range(len(fps) - 1):
        diff = turned[i + 1 :] ^ turned[i]
        places = np.arange(i + 1, len(fps))
        for mask, most in masks:  # the last mask is the full Hamming check
            within = np.bitwise_count(diff & np.uint64(mask)) <= most
            diff, places = diff[within], places[within]
            if not len(places):
                break
        for j in places.tolist():
            if root[i] != root[j]:
                edges.append((i, j))
                root[root == root[j]] = root[i]
    return edges


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, segments: int = SEGMENTS) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of `fps` (fp long) that hang together as all links at `distance` or fewer bits do.

    Round the ring of segments, two fingerprints that differ in d bits have a segment from which on every chain's
    differences stay within its share, distance * length / segments. The first segments of such a chain, those whose share
    is below one, may not differ at all: by them fingerprints are joined, once for each start, and the longer chains prune
    before all bits are compared. A bucket of one value is cut into blocks of about `block` rows and every pair of blocks is
    a group of its own, so that no bucket lands in one task, nor do its rows when they are dealt to their blocks; a group yields a spanning forest of its links, not its pairs.
    No partner is dropped.
    """
    masks = ring_masks(distance, segments)
    width, zero = BITS // segments, masks[0][0] if masks[0][1] == 0 else 0
    turned = lambda by: F.col("fp") if by == 0 else F.shiftrightunsigned("fp", by).bitwiseOR(F.shiftleft("fp", BITS - by))
    keys = fps.select("fp", F.posexplode(F.array(*[turned(width * i).bitwiseAND(F.lit(zero)) for i in range(segments)])).alias("i", "value"))
    rows = with_sizes(keys, ["i", "value"], "fp")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("i", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    order = ["i", "value", "a", "b"]
    rows = rows.repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = yield from flush(batch if held is None else pa.concat_batches([held, batch]))
        if held is not None:
            yield from flush(held, last=True)

    def flush(batch: pa.RecordBatch, last: bool = False):
        """Yields the edges of the groups that have ended; returns the rows of the group that hasn't."""
        if not batch.num_rows:
            return None
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:4]:
            change |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1, batch.num_rows]
        if not last:
            starts = starts[:-1]
        fps, which, out = columns[4].view(np.uint64), columns[0], []
        for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if b - a > 1:
                out += [(a + i, a + j) for i, j in linked(fps[a:b], int(which[a]) * width, masks)]
        if out:
            pairs = fps[np.array(out)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])
        return None if last else batch.slice(int(starts[-1]))

    return rows.mapInArrow(run, "u long, v long")


def simhash_components(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the fingerprint of its text in hexadecimal, and the smallest id that is reached by links of `distance` or fewer differing bits.

    Equal fingerprints are one node, so copies make no pairs. Null and empty texts have fingerprint zero and are linked
    like any other; a null id stays null and is never a component's smallest unless all are null; repeated rows each get
    their row; an empty table gives no rows.
    """
    rows = checkpointed(fingerprints(df, shingle, id_col, text_col).withColumnRenamed("fp", "node"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    known = smallest_of_each(nodes.select("node", "first"), links(nodes.select(F.col("node").alias("fp")), distance)).drop("best")
    out = spread_join(rows, known, "node", "doc_id", heavy_keys(nodes, "node", "n"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicates by shingles of words: words of a shingle, the least Jaccard similarity, 64-bit words of a fingerprint,
#: and the keys by which candidates meet: each is made of the least of `PER_KEY` permuted shingle hashes, so that texts
#: of similarity s share a key with probability 1 - (1 - s ** PER_KEY) ** KEYS, over 0.99999 at 0.8.
NEAR_SHINGLE, SIMILARITY, WIDE, KEYS, PER_KEY = 5, 0.8, 4, 12, 2
#: The most differing bits, of 256, of a candidate: over four standard deviations above the mean at 0.8. Texts of fewer distinct
#: shingles than FEW, whose majorities are often ties, are candidates at any distance.
WIDE_DISTANCE, FEW = 64, 32


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = (hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_sketch(words: list[bytes], shingle: int = NEAR_SHINGLE) -> tuple[bytes, list[int], np.ndarray]:
    """The fingerprint of WIDE * 64 bits, the candidate keys and the distinct shingles (32 bits each) of a text."""
    hashes = np.unique(shingle_hashes(words, shingle).astype(np.uint64))
    print_ = [majority(_mixed(hashes, k + 1)) for k in range(WIDE)]
    least = [int(_mixed(hashes, 100 + k).min()) for k in range(KEYS * PER_KEY)]
    keys = [hash(tuple(least[k * PER_KEY : (k + 1) * PER_KEY]) + (k,)) for k in range(KEYS)]  # of integers alone: equal on all machines
    return b"".join(print_), keys, np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def wide_links(prints: np.ndarray, few: np.ndarray, distance: int = WIDE_DISTANCE) -> list[tuple[int, int]]:
    """The closest links, by differing bits, that hang a block's fingerprints together; prints is rows of 16 segments of 16 bits, few marks those that no distance prunes.

    Round the ring of segments some chain keeps each of its sums of differences within its share of the distance, or the
    pair is farther apart; only pairs with such a chain are candidates.
    """
    n, pairs = len(prints), []
    for i in range(n - 1):
        diff = np.bitwise_count(prints[i + 1 :] ^ prints[i]).astype(np.int64)
        any_ = few[i + 1 :] | few[i]
        ring = np.concatenate([diff, diff], axis=1)
        m = diff.shape[1]
        alive, total = np.ones_like(diff, bool), np.zeros_like(diff)
        for length in range(1, m + 1):
            total += ring[:, length - 1 : length - 1 + m]
            alive &= total * m <= distance * length
            if length in (1, 2, 4) and not alive.any():
                break
        for j in np.flatnonzero(alive.any(axis=1) | any_).tolist():
            pairs.append((int(diff[j].sum()), i, i + 1 + j))
    root, edges = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, i, j in sorted(pairs):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            edges.append((i, j))
    return edges


def true_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that hang together all sets (of distinct numbers) that hang together by Jaccard similarities of `similarity` or more; every pair is compared."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = often > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column, common = row[order], column[order], np.zeros((n, n), np.int64)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        holds = np.zeros((n, 4096), np.float32)
        holds[row[a:b], column[a:b] - start] = 1
        common += (holds @ holds.T).astype(np.int64)
    linked_, fresh, out = common >= similarity * (sizes[:, None] + sizes - common), np.ones(n, bool), []
    for i in range(n):
        if fresh[i]:
            fresh[i], reached = False, [i]
            for x in reached:
                new = np.flatnonzero(linked_[x] & fresh)
                fresh[new] = False
                reached += new.tolist()
                out += [(x, y) for y in new.tolist()]
    return out


def text_key(text: Column) -> Column:
    """A 64-bit key of a text: of ten thousand million different texts a few share theirs."""
    return F.xxhash64(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `df`, with all their columns, that near-duplicate removal keeps: of each group of `near_duplicates` the row of the smallest id.

    A null id is larger than every other; of rows of that id with different texts the one of the least text key stays, of
    repeated rows (same id, same text) one. Rows are told apart by id and text. An empty table gives no rows.
    """
    best = _groups(df, id_col=id_col, text_col=text_col, **settings)[1].where(F.col("node") == F.col("best")).select("node", id_key(F.col("component_id")).alias("id"))
    rows = nested(df, text_key(df[text_col]).alias("node"), id_key(df[id_col]).alias("id"))
    return rows.join(best, ["node", "id"], "left_semi").dropDuplicates(["node", "id"]).select("row.*")


def near_duplicates(df: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", distance: int | None = WIDE_DISTANCE) -> DataFrame:
    """(doc_id, component_id) for each row: the smallest id that is reached by links between texts whose sets of word shingles have Jaccard similarity `similarity` or more.

    Texts without words are one group; a null id stays null and counts only where no other is; repeated rows each get
    their row; an empty table gives no rows. With a `distance` of None no pair that shares a key is pruned by its
    fingerprints. See `_groups` for the method.
    """
    rows, groups, firsts = _groups(df, shingle, similarity, block, id_col, text_col, distance)
    return spread_join(rows, groups, "node", "doc_id", heavy_keys(firsts, "node", "n")).select("doc_id", "component_id")


def _groups(df: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", distance: int | None = WIDE_DISTANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, node) of each row, (node, component_id, best) and (node, first, n) of each distinct text, a node.

    At that similarity fingerprints differ in too many bits for segments that agree, so candidates meet by keys of least
    shingle hashes. Their fingerprints are compared round the ring of segments; the closest links that hang a block
    together are checked on the shingles themselves. Where one of them fails, it may have displaced others, so all pairs of
    the texts that it hung together are checked. So no link that a key shows is lost. Exact copies are one node. A key's
    rows are cut into blocks, and every pair of blocks is a group of its own.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows of an owner lie in one partition
        for batch in slices(batches):
            fresh = [not (x in seen or seen.add(x)) for x in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            made = [wide_sketch(x.lower().split(), shingle) for x in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.list_(pa.int64())), pa.array([x[2] for x in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "print", "keys", "shingles"])

    texts = id_and_text(df, id_col, text_col).withColumn("node", text_key(F.col("text")))
    rows = checkpointed(texts.select("doc_id", "node"))
    firsts = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    # One row of each text makes its sketch; which row that is doesn't matter, as they are equal.
    owners = firsts.select(F.col("node").alias("its"), "first").hint("shuffle_hash")
    one = texts.select("doc_id", "node", "text").join(owners, (F.col("node") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("first")))
    sketched = checkpointed(one.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(sketches, "node long, print binary, keys array<long>, shingles array<int>"))

    few = F.lit(True) if distance is None else F.size("shingles") < FEW
    keyed = sketched.select("node", "print", few.alias("few"), F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = keyed.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "print", "few")
    order = ["key", "a", "b"]
    met = met.repartition(*order).sortWithinPartitions(*order, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            held = group(batch, False, out)
            yield edges(out)
        if held is not None:
            group(held, True, out)
            yield edges(out)

    def group(batch: pa.RecordBatch, last: bool, out: list) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        change = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
        starts = np.r_[0, np.flatnonzero(change) + 1, batch.num_rows].tolist()
        prints = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        nodes, few = columns[3], batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in zip(starts, starts[1:] if last else starts[1:-1], strict=False):
            if b - a > 1:
                x, first = np.unique(nodes[a:b], return_index=True)
                out += named([(int(x[i]), int(x[j])) for i, j in wide_links(prints[a:b][first], few[a:b][first], WIDE_DISTANCE if distance is None else distance)])
        return None if last else batch.slice(starts[-2])

    def named(links_: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Each link behind a number for the texts that hang together with it, the same wherever just these do."""
        near = defaultdict(list)
        for u, v in links_:
            near[u].append(v)
            near[v].append(u)
        group_of = {}
        for node in near:
            if node not in group_of:
                reached = {node: None}
                stack = [node]
                while stack:
                    new = [y for y in near[stack.pop()] if y not in reached]
                    reached.update(dict.fromkeys(new))
                    stack += new
                group_of.update(dict.fromkeys(reached, hash(tuple(sorted(reached)))))  # of integers alone
        return [(group_of[u], u, v) for u, v in links_]

    def edges(out: list) -> pa.RecordBatch:
        found = sorted({(g, min(u, v), max(u, v)) for g, u, v in out})
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in range(3)], names=["g", "u", "v"])

    def recheck(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The true links of each group (g, node, shingles), whose rows follow each other; a group has two blocks of texts at most."""
        of, nodes, its = None, [], []
        for batch in batches:
            arrays, empty = batch.column(2), np.zeros(0, np.int32)
            for k, (g, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if g != of:
                    yield from checked(nodes, its)
                    of, nodes, its = g, [], []
                nodes.append(node)
                its.append(np.concatenate([empty, arrays[k].values.to_numpy()]))
        yield from checked(nodes, its)

    def checked(nodes: list[int], its: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if nodes:
            found = [(nodes[i], nodes[j]) for i, j in true_links(its, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in range(2)], names=["u", "v"])

    pairs = checkpointed(met.mapInArrow(run, "g long, u long, v long").distinct())
    sets = sketched.select("node", "shingles")
    both = pairs.select("u", "v").distinct().join(sets.withColumnsRenamed({"node": "u", "shingles": "x"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "y"}), "v")
    common = F.size(F.array_intersect("x", "y"))
    judged = checkpointed(both.select("u", "v", (common >= similarity * (F.size("x") + F.size("y") - common)).alias("holds")))
    failed = pairs.join(judged.where("not holds"), ["u", "v"]).select("g").distinct()
    # A group of two texts has no other pair.
    again = pairs.join(failed, "g").select("g", F.explode(F.array("u", "v")).alias("node")).distinct()
    again = again.join(again.groupBy("g").agg(F.count("*").alias("n")).where("n > 2"), "g").select("g", "node")
    again = again.join(sets, "node").select("g", "node", "shingles").repartition("g").sortWithinPartitions("g", "node")
    found = judged.where("holds").select("u", "v").union(again.mapInArrow(recheck, "u long, v long"))
    return rows, smallest_of_each(firsts.select("node", "first"), found), firsts

"""The prefix trie of conversations by the Euler-tour technique."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import heavy_keys, spread_join, written

#: Ids go in groups of so many, whose first conversation lends up to SHARED - 1 turns to the others.
GROUP, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Arcs that are linked in one go within a task, and ids that are joined to one string at once.
BLOCK, IDS = 1 << 16, 1 << 13
#: An arc is (conversation, 2 * depth) where the tour enters a node, and (conversation, 2 * depth + 1) where it leaves it.
SUMS = ("n", "leaves", "saved")


def _sorted(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sorted over all partitions: by ranges, so that the rows of one key may lie in several partitions on end."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


class Scan:
    """Running results within runs of equal keys, over the batches of a sorted partition."""

    def __init__(self, op: np.ufunc, back: np.ufunc):
        self.op, self.back, self.key, self.last = op, back, None, 0

    def __call__(self, key: np.ndarray, values: np.ndarray) -> np.ndarray:
        fresh = np.r_[self.key is None or key[0] != self.key, key[1:] != key[:-1]]
        total = self.op.accumulate(values)
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        out = self.back(total, np.r_[values.dtype.type(0), total[:-1]][start])
        if not fresh[0]:
            own = len(key) if not fresh.any() else int(fresh.argmax())
            out[:own] = self.op(out[:own], self.last)
        self.key, self.last = key[-1], out[-1]
        return out


def _before(rows: DataFrame, key: str, **totals: Column) -> DataFrame:
    """(key, part, ...) of what a key has in the partitions before: a row a partition at most, as only its first key can have begun before it."""
    own = rows.groupBy(key, "part").agg(*[v.alias(k) for k, v in totals.items()])
    over = "OVER (PARTITION BY {} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)".format(key)
    fold = {"n": "sum"}
    return F.broadcast(own.select(key, "part", *[F.expr(f"{fold.get(k, 'bit_xor')}({k}) {over}").alias(f"{k}_before") for k in totals]).where(" OR ".join(f"{k}_before IS NOT NULL" for k in totals)))


def _numbered(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, digest, words) with `p`, their number in their conversation, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(np.add, np.subtract)
        for batch in batches:
            if batch.num_rows:
                at = scan(batch.column(0).to_numpy(), np.ones(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(at)], names=["conv_id", "digest", "words", "local"])

    rows = _sorted(turns, "conv_id", "turn", "digest").mapInArrow(run, "conv_id long, digest binary, words long, local long")
    rows = written(rows.withColumn("part", F.spark_partition_id()))
    rows = rows.join(_before(rows, "conv_id", n=F.max("local")), ["conv_id", "part"], "left")
    return rows.select("conv_id", "digest", "words", (F.col("local") + F.coalesce("n_before", F.lit(0))).alias("p"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """The rebuilt turns (conv_id, depth, digest, words, last) with `key`, which tells their whole prefix, and `up`, that of the prefix without them.

    A prefix is told by the xor of two 64-bit hashes of its turns, each hashed with its depth. Such sums can be taken in
    pieces, so that no conversation needs to lie in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = [Scan(np.bitwise_xor, np.bitwise_xor) for _ in range(2)]
        for batch in batches:
            if batch.num_rows:
                sums = [pa.array(scan(batch.column(0).to_numpy(), batch.column(4 + i).to_numpy())) for i, scan in enumerate(scans)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names, "s1", "s2"])

    hashed = rows.select("conv_id", "depth", "words", "last", *[F.xxhash64(F.lit(i), "depth", "digest").alias(f"x{i}") for i in (1, 2)])
    out = _sorted(hashed, "conv_id", "depth").mapInArrow(run, "conv_id long, depth long, words long, last boolean, x1 long, x2 long, s1 long, s2 long")
    out = written(out.withColumn("part", F.spark_partition_id()))
    out = out.join(_before(out, "conv_id", **{s: F.max_by(s, "depth") for s in ("s1", "s2")}), ["conv_id", "part"], "left")
    for i in (1, 2):
        out = out.withColumn(f"s{i}", F.col(f"s{i}").bitwiseXOR(F.coalesce(f"s{i}_before", F.lit(0))))
    up = F.struct((F.col("depth") - 1).alias("depth"), *[F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"s{i}") for i in (1, 2)])
    return out.select("conv_id", F.struct("depth", "s1", "s2").alias("key"), up.alias("up"), "words", "last")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of each conversation, and its rebuilt turns (conv_id, depth, digest, words, last)."""
    turns = _numbered(turns)
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", own.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("group"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("group"), F.col("n").alias("n_group")), "group", "left").withColumn("lent", F.least("h", F.coalesce("n_group", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    # A very long conversation's turns are dealt out.
    rest = spread_join(turns.where(F.col("p") > own), convs.select("conv_id", "h", "lent", "length"), "conv_id", "p", heavy_keys(convs, "conv_id", "n"))
    rest = rest.withColumn("depth", F.col("p") - F.col("h") + F.col("lent"))
    # Fewer than SHARED rows a group.
    heads = turns.where((F.col("p") < SHARED) & (F.col("conv_id") % GROUP == 0)).groupBy(F.col("conv_id").alias("group")).agg(F.collect_list(F.struct(F.col("p").alias("depth"), "digest", "words")).alias("heads"))
    lent = convs.where("lent > 0").join(heads, "group").select("conv_id", "lent", "length", F.explode("heads").alias("t")).select("conv_id", "lent", "length", "t.*").where("depth <= lent")
    columns = ["conv_id", "depth", "digest", "words", (F.col("depth") == F.col("length")).alias("last")]
    return convs.select("conv_id", "length"), rest.select(*columns).union(lent.select(*columns))


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the ids that end at each node. Ids are joined in pieces in their order, and the pieces hashed one after the other."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [c.to_numpy() for c in batch.columns[:3]], batch.column(3).to_numpy()
            new = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(ids) else np.zeros(0, int)
            cuts = np.union1d(new, np.arange(0, len(ids), IDS))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.r_[cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts]) for x in (*keys, ids)), pa.array(texts, pa.string())], names=["depth", "s1", "s2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for *own, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256()
                sha.update(text.encode())
            yield _table(done)
            done = []
        if key is not None:
            yield _table([(*key, sha.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["depth", "s1", "s2", "sha"])

    key = ["depth", "s1", "s2"]
    pieces = _sorted(members.select("key.*", "conv_id"), *key, "conv_id").mapInArrow(joined, "depth long, s1 long, s2 long, first long, ids string")
    found = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, s1 long, s2 long, sha string")
    return found.select(F.struct(*key).alias("key"), F.col("sha").alias("ends_sha256"))


def _siblings(kids: DataFrame) -> DataFrame:
    """`kids` with `next`, the next child of their parent by id; a parent's children may lie in many partitions."""
    keys = ["parent", "depth", F.desc("conv_id")]
    fields = {f.name: f.dataType.simpleString() for f in kids.schema}
    columns = [c for c in fields if c not in ("parent", "depth", "conv_id")]
    fields = ["parent", "depth", "conv_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                parent, depth, conv = (c.to_numpy() for c in batch.columns[:3])
                same = np.r_[last is not None and last[:2] == (parent[0], depth[0]), (parent[1:] == parent[:-1]) & (depth[1:] == depth[:-1])]
                next_ = pa.array(np.r_[last[2] if last else 0, conv[:-1]], pa.int64(), mask=~same)
                first = pa.array(np.r_[last is None, np.zeros(len(conv) - 1, bool)])
                last = parent[-1], depth[-1], conv[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, next_, first], names=[*batch.schema.names, "next", "first"])

    schema = kids.select(*fields).schema.add("next", "long").add("first", "boolean")
    rows = _sorted(kids.select(*fields), *keys).mapInArrow(run, schema)
    rows = written(rows.withColumn("part", F.spark_partition_id()))
    # The last row of each partition goes to the next one that has rows: a row a partition.
    order = F.struct("parent", "depth", (-F.col("conv_id")).alias("down"))
    tails = rows.groupBy("part").agg(F.max(order).alias("tail")).selectExpr("part", "lag(tail) OVER (ORDER BY part) AS tail", "true AS first")
    rows = rows.join(F.broadcast(tails), ["part", "first"], "left")
    over = F.when((F.col("tail.parent") == F.col("parent")) & (F.col("tail.depth") == F.col("depth")), -F.col("tail.down"))
    return rows.select(*fields, F.coalesce("next", over).alias("next"))


def link(conv: np.ndarray, arc: np.ndarray, next_conv: np.ndarray, next_arc: np.ndarray, more: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains the arcs of one block where the arc behind is in the block too: the place of each arc's chain's first arc, the sums of the chain up to the arc, and, at the first arcs, the place of the chain's last."""
    m = len(conv)
    known, code = np.unique(conv, return_inverse=True)
    width = int(max(arc.max(), next_arc.max())) + 1
    keys = code * width + arc
    order = np.argsort(keys)
    near = np.minimum(np.searchsorted(known, next_conv), len(known) - 1)
    to = near * width + next_arc
    at = order[np.minimum(np.searchsorted(keys, to, sorter=order), m - 1)]
    behind = np.where(more & (known[near] == next_conv) & (keys[at] == to), at, -1)
    inside = np.flatnonzero(behind >= 0)
    jump = np.full(m, -1)
    jump[behind[inside]] = inside
    # Pointer jumping towards the first arcs.
    head, sums = np.arange(m), sums.copy()
    rest = np.flatnonzero(jump >= 0)
    while len(rest):
        far = jump[rest]
        sums[rest] += sums[far]
        head[rest] = head[far]
        jump[rest] = jump[far]
        rest = rest[jump[rest] >= 0]
    last = np.full(m, -1)
    ends = np.flatnonzero(behind < 0)
    last[head[ends]] = ends
    return head, sums, last


def _chained(arcs: DataFrame) -> DataFrame:
    """The arcs, each with the first arc of its chain (head_conv, head_arc), the sums up to it, `own` sums, and, at the first arc, `chain`: what comes behind the chain, and its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            conv, arc, next_conv, next_arc = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(4))
            more = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            head, sums, last = link(conv, arc, next_conv, next_arc, more, np.stack([batch.column(i).to_numpy() for i in range(4, 7)], 1))
            end = np.maximum(last, 0)
            none = pa.array(~more[end])
            chain = [pc.if_else(none, None, pa.array(x[end])) for x in (next_conv, next_arc)] + [pa.array(sums[end, i]) for i in range(3)]
            chain = pa.StructArray.from_arrays(chain, names=["next_conv", "next_arc", *SUMS], mask=pa.array(last < 0))
            own = pa.StructArray.from_arrays(batch.columns[4:7], names=list(SUMS))
            upto = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(sums[:, i])) for i in range(3)], names=list(SUMS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(conv[head]), pa.array(arc[head]), upto, own, chain], names=["conv_id", "arc", "head_conv", "head_arc", "upto", "own", "chain"])

    sums = "struct<n:bigint,leaves:bigint,saved:bigint>"
    return arcs.mapInArrow(run, f"conv_id long, arc long, head_conv long, head_arc long, upto {sums}, own {sums}, chain struct<next_conv:bigint,next_arc:bigint,n:bigint,leaves:bigint,saved:bigint>")


def _ranked(arcs: DataFrame) -> DataFrame:
    """(conv_id, arc, n, leaves, saved): the sums over a list from each of its `arcs` (conv_id, arc, next_conv, next_arc, n, leaves, saved) on.

    Arcs that follow each other within a block are chained, and the list of chains, far shorter for arcs in the trie's order, is
    ranked in the same way, in blocks that reach further. Once chaining shortens a list no more by half, the rest is
    ranked by pointer jumping: rounds of joins, each of which doubles how far an arc's sums reach.
    """
    rows = written(_chained(arcs))
    chains = rows.where("chain IS NOT NULL").select("conv_id", "arc", "chain.*")
    n, left = rows.count(), chains.count()
    if chains.where("next_conv IS NOT NULL").isEmpty():
        ranked = chains.select("conv_id", "arc", *SUMS)
    elif 2 * left <= n:
        ranked = _ranked(chains.coalesce(-(-left // BLOCK)))
    else:
        ranked = _jumped(chains)
    far = ranked.select(F.col("conv_id").alias("head_conv"), F.col("arc").alias("head_arc"), F.struct(*SUMS).alias("far"))
    # A few rows, counted, or else a join in which a chain has BLOCK rows at most.
    rows = rows.join(F.broadcast(far) if left <= BLOCK else far, ["head_conv", "head_arc"])
    return rows.select("conv_id", "arc", *[(F.col(f"far.{x}") - F.col(f"upto.{x}") + F.col(f"own.{x}")).alias(x) for x in SUMS])


def _jumped(arcs: DataFrame) -> DataFrame:
    """`_ranked` by pointer jumping alone."""
    arcs = written(arcs)
    while not arcs.where("next_conv IS NOT NULL").isEmpty():
        far = arcs.select(F.col("conv_id").alias("next_conv"), F.col("arc").alias("next_arc"), F.struct("next_conv", "next_arc", *SUMS).alias("far"))
        open_ = arcs.where("next_conv IS NOT NULL").join(far, ["next_conv", "next_arc"])
        open_ = open_.select("conv_id", "arc", "far.next_conv", "far.next_arc", *[(F.col(x) + F.col(f"far.{x}")).alias(x) for x in SUMS])
        arcs = written(arcs.where("next_conv IS NULL").select("conv_id", "arc", "next_conv", "next_arc", *SUMS).union(open_))
    return arcs.select("conv_id", "arc", *SUMS)


def _tour(nodes: DataFrame) -> DataFrame:
    """The arcs of `nodes` (conv_id, depth, parent, next, child, cost) with the arc behind each, sorted by node."""
    conv, depth, leaf = F.col("conv_id"), F.col("depth"), F.col("child").isNull()
    arc = lambda at, conv_, at_, leaves, saved: F.struct(at.alias("arc"), conv_.alias("next_conv"), at_.alias("next_arc"), F.lit(1).cast("long").alias("n"), leaves.cast("long").alias("leaves"), saved.cast("long").alias("saved"))
    enter = arc(2 * depth, F.when(leaf, conv).otherwise(F.col("child")), F.when(leaf, 2 * depth + 1).otherwise(2 * depth + 2), leaf, F.col("cost"))
    behind = F.when(F.col("next").isNotNull(), 2 * depth).when(F.col("parent").isNotNull(), 2 * depth - 1)
    leave = arc(2 * depth + 1, F.coalesce("next", "parent"), behind, F.lit(0), F.lit(0))
    return _sorted(nodes, "conv_id", "depth").select("conv_id", F.explode(F.array(enter, leave)).alias("a")).select("conv_id", "a.*")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and entered and left, the places of its arcs in the tour.

    A node is told by its smallest member and its depth. Texts are read once, as a digest and a count of words. Turns are
    numbered, prefixes hashed and siblings put in order by sorting over ranges, where a range takes over what the ones
    before it have of its first key, so that neither a long conversation nor a node with many children lies in one task. Each node gives the arcs by
    which the tour enters and leaves it; each arc knows the one behind it: to its first child or back, to the next sibling
    or up. The tour is list-ranked with three weights, places, leaves and costs, whose sums from either arc of a node on
    differ by its subtree. A node's ids are hashed in order, as its digest asks, in bounded memory.

    Rows without conv_id belong to no conversation. Null roles and texts are empty; null turns come first, turns of one
    number go by their digests, and repeated rows are turns of their own. A group's first conversation is id - id % 20 with the sign of id. Other columns aren't read; an
    empty table has no root and gives no rows.
    """
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = df.select(df[conv_col].cast("long").alias("conv_id"), df[turn_col].alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).where("conv_id IS NOT NULL")
    convs, rebuilt = _rebuilt(written(turns))
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    members = _prefixes(rebuilt).union(convs.select("conv_id", root.alias("key"), F.lit(None).alias("up"), F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("last")))
    nodes = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("up").alias("up"))
    nodes = written(nodes.withColumn("cost", (F.col("n_convs") - 1) * F.col("words")).drop("words"))
    kids = nodes.where("up IS NOT NULL")
    children = kids.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child"))
    whole = nodes.join(children, "key", "left").join(_ends(members.where("last")), "key", "left")
    whole = whole.select(F.col("key.depth").alias("depth"), "conv_id", "n_convs", "cost", "up", F.coalesce("n_children", F.lit(0)).alias("n_children"), "child", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    # The children of a node with very many are dealt out.
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    below = spread_join(whole.where("up IS NOT NULL"), parents, "up", "conv_id", heavy_keys(children.withColumnRenamed("key", "up"), "up", "n_children")).drop("up")
    below = _siblings(below)
    top = whole.where("up IS NULL").withColumn("parent", F.lit(None).cast("long")).withColumn("next", F.lit(None).cast("long"))
    nodes = written(below.unionByName(top.drop("up")))
    arcs = _ranked(_tour(nodes))
    by = lambda enter, leave: F.sum(F.when(F.col("arc") % 2 == 0, enter).otherwise(leave))
    # Sums from the two arcs of a node on differ by its subtree; places are counted from the other end.
    sums = arcs.groupBy("conv_id", F.floor(F.col("arc") / 2).alias("depth")).agg(*[by(F.col(x), -F.col(x)).alias(f"in_{x}") for x in SUMS[1:]], by(F.col("n"), F.lit(0)).alias("enter_n"), by(F.lit(0), F.col("n")).alias("leave_n"))
    total = F.lit(2 * nodes.count())
    return nodes.join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("in_leaves").alias("n_leaves"), F.col("in_saved").alias("saved_tokens"), "ends_sha256",
        (total - F.col("enter_n")).alias("entered"), (total - F.col("leave_n")).alias("left"),
    )

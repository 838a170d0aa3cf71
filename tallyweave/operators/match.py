"""Matching two registers of the same people through tiers of ever weaker keys."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.lineage import checkpointed
from tallyweave.functions.text import department, title_department

#: (basis, key columns besides the batch, whether the last right row of a key counts instead of an only one)
TIERS = (
    (rules.BASIS_ID, ("k_id",), True),
    (rules.BASIS_NAME, ("k_name",), False),
    (rules.BASIS_DEPT, ("k_name", "k_dept"), False),
    (rules.BASIS_FLAG, ("k_name", "k_flag"), False),
    (rules.BASIS_AMOUNTS, ("k_name", "pay", "prof", "mgr", "tutor"), False),
    (rules.BASIS_LEFT, ("k_name",), False),
)


def sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both registers as rows of one frame with their keys, so that every tier is one window and no tier doubles the plan.

    Left rows have (batch_id, row_ord, person_id, name, title, measures), right rows dept in place of title.
    """
    measures = [F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in rules.MEASURES]
    key = lambda x: F.when(x != "", x)
    own = lambda side, dept: [F.lit(side).alias("side"), "batch_id", "row_ord", key(F.upper(F.trim(F.coalesce("person_id", F.lit(""))))).alias("k_id"), F.coalesce("name", F.lit("")).alias("k_name"), dept.alias("k_dept"), (F.coalesce("mgr", F.lit(0)) > 0).alias("k_flag"), *measures]
    # A title whose department is known gives it; a right row's own department counts if it isn't blank.
    derived = left.withColumn("__d", title_department(F.col("title"))).select(*own("L", F.when(F.col("__d").isNotNull(), department(F.col("__d")))))
    return derived.unionByName(right.select(*own("R", F.when(F.trim(F.coalesce("dept", F.lit(""))) != "", department(F.col("dept"))))))


def match_on_key(rows: DataFrame, keys: tuple[str, ...], basis: str, last: bool = False, single: bool = False) -> DataFrame:
    """One tier over `sides`: the right row whose key no other unused right row has (or the last that has it) goes to the first unused left row of the key.

    Rows with a null in the key take no part. With `single` the left row must be alone, too.
    """
    free = F.col("partner").isNull()
    for k in keys:
        free = free & F.col(k).isNotNull()
    window = W.partitionBy("batch_id", *keys)
    left, right = free & (F.col("side") == "L"), free & (F.col("side") == "R")
    rows = rows.withColumns({
        "__n": F.count_if(right).over(window), "__m": F.count_if(left).over(window),
        "__l": F.min(F.when(left, F.col("row_ord"))).over(window), "__r": F.max(F.when(right, F.col("row_ord"))).over(window),
    })
    takes = (F.col("__n") >= 1 if last else F.col("__n") == 1) & (F.col("__m") == 1 if single else F.col("__m") >= 1)
    hit = takes & ((left & (F.col("row_ord") == F.col("__l"))) | (right & (F.col("row_ord") == F.col("__r"))))
    other = F.when(F.col("side") == "L", F.col("__r")).otherwise(F.col("__l"))
    return rows.withColumn("basis", F.when(hit, basis).otherwise(F.col("basis"))).withColumn("partner", F.when(hit, other).otherwise(F.col("partner"))).drop("__n", "__m", "__l", "__r")


def tiers(rows: DataFrame, upto: int = len(TIERS)) -> DataFrame:
    """All keyed tiers. Adds partner (the other side's row_ord), basis, and pending: a left row whose name several unused right rows bear after the name tier."""
    rows = rows.withColumn("partner", F.lit(None).cast("bigint")).withColumn("basis", F.lit(None).cast("string")).withColumn("pending", F.lit(False))
    for k, (basis, keys, last) in enumerate(TIERS[:upto]):
        rows = match_on_key(rows, keys, basis, last, single=k == 5)
        if k == 1:
            names = F.count_if((F.col("side") == "R") & F.col("partner").isNull()).over(W.partitionBy("batch_id", "k_name"))
            rows = rows.withColumn("pending", (F.col("side") == "L") & F.col("partner").isNull() & (names >= 2))
    return rows


def closest(name: str, known: list[str], cutoff: float) -> str | None:
    """The known name of the greatest matching ratio from `cutoff` on; of equals the last in order."""
    return Likeness(known).closest(name, cutoff)


class Likeness:
    """The names of one batch, ready to be compared with others. The letters in common bound a ratio from above, so that few are worked out."""

    def __init__(self, names: Iterable[str]):
        self.names = sorted(set(names))
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(self.names))))}
        self.counts = np.zeros((len(self.names), len(self.letters)), np.int16)
        for i, name in enumerate(self.names):
            for c in name:
                self.counts[i, self.letters[c]] += 1
        self.sizes = np.array([len(n) for n in self.names], np.int64)
        self.free = np.ones(len(self.names), bool)

    def take(self, name: str) -> None:
        """Leaves a name out from now on."""
        self.free[bisect_left(self.names, name)] = False

    def closest(self, name: str, cutoff: float) -> str | None:
        own = np.zeros(len(self.letters), np.int16)
        for c in name:
            if c in self.letters:
                own[self.letters[c]] += 1
        whole = self.sizes + len(name)
        most = np.where(whole > 0, 2.0 * np.minimum(self.counts, own).sum(axis=1) / np.maximum(whole, 1), 1.0)
        at = np.flatnonzero(self.free & (most >= cutoff))
        matcher, best = SequenceMatcher(), None
        matcher.set_seq2(name)
        for i in at[np.argsort(-most[at], kind="stable")].tolist():
            if best is not None and most[i] < best[0]:
                break
            matcher.set_seq1(self.names[i])
            if (r := matcher.ratio()) >= cutoff and (best is None or (r, self.names[i]) > best):
                best = (r, self.names[i])
        return None if best is None else best[1]


def fuzzy_pairs(rows: DataFrame, cutoff: float = rules.MATCH_CUTOFF) -> DataFrame:
    """(batch_id, left_ord, right_ord) of names one letter apart, among what the keyed tiers left.

    In left order each row takes its closest free name, if that is one letter apart and no other free row bears it. A take
    changes what is free for the next, so a batch, the size of one file, is handled in order in one task. Left rows without
    any free name one letter apart can't take; they are left out before, by joining names with one letter left out.
    """
    free = rows.where(F.col("partner").isNull() & ~F.col("pending")).select("batch_id", "side", "row_ord", "k_name")
    holes = F.transform(F.sequence(F.lit(1), F.length("k_name")), lambda i: F.concat_ws(":", i.cast("string"), F.left("k_name", i - 1), F.substring(F.col("k_name"), i + 1, F.length("k_name"))))
    holed = free.where(F.length("k_name") > 0).select("batch_id", "side", "row_ord", F.explode(holes).alias("hole"))
    near = holed.where("side = 'L'").join(holed.where("side = 'R'").select("batch_id", "hole").distinct(), ["batch_id", "hole"]).select("batch_id", "row_ord").distinct()
    lefts = free.where("side = 'L'").join(near, ["batch_id", "row_ord"], "left_semi")
    free = lefts.unionByName(free.where("side = 'R'").join(near.select("batch_id").distinct(), "batch_id", "left_semi"))

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_ord")
        pool = group[group.side == "R"]
        by_name: dict[str, list[int]] = {}
        for name, ord_ in zip(pool.k_name, pool.row_ord, strict=True):
            by_name.setdefault(name, []).append(ord_)
        known, out = Likeness(by_name), []
        for name, ord_ in zip(group[group.side == "L"].k_name, group[group.side == "L"].row_ord, strict=True):
            best = known.closest(name, cutoff)
            if best is not None and len(best) == len(name) and sum(a != b for a, b in zip(best, name, strict=True)) == 1 and len(by_name[best]) == 1:
                out.append((ord_, by_name.pop(best)[0]))
                known.take(best)
        frame = pd.DataFrame(out, columns=["left_ord", "right_ord"]).astype("int64")
        frame.insert(0, "batch_id", group.batch_id.iloc[0])
        return frame

    return free.groupBy("batch_id").applyInPandas(greedy, f"batch_id {rows.schema['batch_id'].dataType.simpleString()}, left_ord long, right_ord long")


def match_cascade(left: DataFrame, right: DataFrame, cutoff: float = rules.MATCH_CUTOFF) -> DataFrame:
    """`sides` with partner and basis after all tiers, the fuzzy one included, and ambiguous: whether a name's leftovers wait for a person's decision."""
    rows = tiers(sides(left, right))
    # Several uses follow, here and in comparisons; the tiers run once.
    rows = rows.withColumn("ambiguous", F.col("partner").isNull() & F.max("pending").over(W.partitionBy("batch_id", "k_name")))
    rows = checkpointed(rows)
    pairs = checkpointed(fuzzy_pairs(rows, cutoff))
    ends = pairs.select("batch_id", F.lit("L").alias("side"), F.col("left_ord").alias("row_ord"), F.col("right_ord").alias("more")).unionByName(pairs.select("batch_id", F.lit("R").alias("side"), F.col("right_ord").alias("row_ord"), F.col("left_ord").alias("more")))
    rows = rows.join(ends, ["batch_id", "side", "row_ord"], "left")
    return rows.withColumn("basis", F.coalesce("basis", F.when(F.col("more").isNotNull(), rules.BASIS_NEAR))).withColumn("partner", F.coalesce("partner", "more")).drop("more")


def label(basis: Column, title: Column, right_name: Column) -> Column:
    """The basis as shown: with the department that the title gives for matches by it, with the other name for names one letter apart."""
    dept = F.concat(basis, F.lit("（"), title_department(title), F.lit("）"))
    return F.when(basis == rules.BASIS_DEPT, dept).when(basis == rules.BASIS_NEAR, F.replace(basis, F.lit("{}"), right_name)).otherwise(basis)


def ambiguous_groups(rows: DataFrame) -> DataFrame:
    """Per name the left and right rows that wait for a decision."""
    ords = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("row_ord"))))
    return rows.where("ambiguous").groupBy("batch_id", F.col("k_name").alias("name")).agg(ords("L").alias("left_ords"), ords("R").alias("right_ords"))


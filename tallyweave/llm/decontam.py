"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import id_and_text, id_key, nested
from tallyweave.llm.spans import bound

#: Words of a window, the least plain words in it, the share of an item's windows that must be matched on one alignment,
#: and the share of matched slots that must agree with a one-to-one renaming.
WINDOW, PLAIN, LEAST, CONSISTENT = 8, 3, 0.5, 0.8
#: Words of an item on end, as written, whose windows are all matched on one alignment: a leak even of a long item.
RUN_WORDS = 13
#: Units, by their usual signs and names.
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l cl ms s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars euro euros cent cents usd eur gbp kmh mph hz kb mb gb".split()
#: Number words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half".split()
#: A whole number with its separators and decimals and the letters behind it, or a run of letters and digits. Quantifiers
#: don't give back, so that long runs need no stack.
TOKEN = r"\p{N}++(?:[.,]\p{N}++)*+[\p{L}\p{N}]*+|[\p{L}\p{N}]++"
#: The most bytes of benchmark windows that are broadcast, counted first; more are joined by a shuffle, in which each window
#: of the benchmark is repeated for so many parts of the texts' windows.
BROADCAST_BYTES, PARTS = 32 << 20, 16


def words_of(text: Column) -> Column:
    """Numbers and runs of letters and digits, so that other punctuation and markup don't matter."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical(word: Column, names: bool = True) -> Column:
    """A number, name or unit becomes its placeholder; another word is lower-cased. A name is a word with a capital first letter and small letters."""
    low = F.lower(word)
    typed = F.when(word.rlike(r"^\p{N}"), "<number>")
    if names:
        typed = typed.when(word.rlike(r"^\p{Lu}\p{Ll}+$"), "<name>")
    return (
        typed.when(low.isin(NUMBERS), "<number>")
        .when(low.isin(UNITS), "<unit>")
        .otherwise(low)
    )


def windows(texts: DataFrame, window: int = WINDOW, names: bool = True, spans: bool = False) -> DataFrame:
    """One row for each window of canonical words of which enough are plain: the other columns, `words`, `pos`, the window's hash `sum`, and, with `spans`, `first` and `until`, the words as written that it goes over.

    A run of names or of numbers, such as a full name, is one word, which its first stands for.
    """
    typed = F.transform(words_of(F.col("text")), lambda w, i: F.struct(w.alias("word"), canonical(w, names).alias("kind"), i.alias("at")))
    alone = lambda t: lambda x, i: (i == 0) | ~x["kind"].isin("<name>", "<number>") | (x["kind"] != F.get(t, i - 1)["kind"])
    df = texts.withColumn("typed", bound(typed, lambda t: F.filter(t, alone(t))))
    df = df.withColumn("n", F.size(words_of(F.col("text")))) if spans else df
    df = df.drop("text").withColumns({"words": F.col("typed.word"), "kinds": F.col("typed.kind"), "ats": F.col("typed.at")}).drop("typed")
    df = df.select("*", F.posexplode("kinds").alias("pos", "k0"))
    df = df.withColumns({f"k{i}": F.get("kinds", F.col("pos") + i) for i in range(1, window)})
    kinds = [f"k{i}" for i in range(window)]
    plain = sum((F.when(F.col(k).startswith("<"), 0).otherwise(1) for k in kinds), F.lit(0))
    df = df.where(F.col(kinds[-1]).isNotNull() & (plain >= PLAIN)).withColumn("sum", F.xxhash64(*kinds))
    if spans:
        df = df.withColumns({"first": F.get("ats", F.col("pos")), "until": F.coalesce(F.get("ats", F.col("pos") + window), F.col("n"))})
    return df.drop("kinds", "ats", "n", *kinds)


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, broadcast_bytes: int) -> DataFrame:
    """The alignments of texts (doc_id, row_key) and items that count as leaks."""
    each = windows(id_and_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("text")))
    own = id_and_text(items, item_id_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    own = own.withColumn("item_key", F.xxhash64("text")).distinct()
    # Texts all in capitals or all in small letters show no names; for them the items' windows are also hashed without.
    bench = windows(own, spans=True).withColumn("named", F.lit(1)).union(windows(own, names=False, spans=True).withColumn("named", F.lit(0)))
    bench = bench.select("item_id", "item_key", "named", F.struct(F.col("pos").alias("pos"), "first", "until").alias("item_at"), F.col("sum").alias("item_sum"), F.slice("words", F.col("pos") + 1, WINDOW).alias("theirs"))
    sizes = bench.groupBy("item_id", "item_key").agg(F.count_if(F.col("named") == 1).alias("n"), F.count_if(F.col("named") == 0).alias("n_plain"))
    of = sizes.select("item_id", "item_key", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("n_plain")).alias("item_windows"))
    bench = bench.drop("named").distinct().join(of, ["item_id", "item_key"])
    ours = F.slice("words", F.col("pos") + 1, WINDOW).alias("ours")
    # A row of numbers, an array and its words.
    size = bench.agg(F.sum(F.octet_length(F.array_join("theirs", "")) + 8 * WINDOW + 64)).first()[0] or 0
    hits = _hits(each, ours, bench, size <= broadcast_bytes)

    # Items without a window that has names, being short or rich in numbers and names, are also looked for as written, in whole or in windows.
    spoken = F.transform(words_of(F.col("text")), F.lower)
    weak = own.join(sizes.where("n > 0"), ["item_id", "item_key"], "left_anti").select("item_id", F.xxhash64("item_key").alias("item_key"), spoken.alias("words")).where(F.size("words") > 0)
    lengths = {r[0]: r[1] for r in weak.groupBy(F.least(F.size("words"), F.lit(WINDOW))).agg(F.sum(F.size("words"))).collect()}
    if lengths:
        none = F.array().cast("array<string>")
        theirs = _verbatim(weak.withColumn("item_windows", F.size("words") - F.least(F.size("words"), F.lit(WINDOW)) + 1), list(lengths), F.least(F.size("words"), F.lit(WINDOW)))
        theirs = theirs.select("item_id", "item_key", F.struct(F.col("pos").alias("pos"), F.col("pos").alias("first"), (F.col("pos") + F.col("n")).alias("until")).alias("item_at"), F.col("sum").alias("item_sum"), none.alias("theirs"), "item_windows")
        texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row_key"), spoken.alias("words"))
        hits = hits.union(_hits(_verbatim(texts, list(lengths)), none.alias("ours"), theirs, 96 * sum(lengths.values()) <= broadcast_bytes))

    pair = ["doc_id", "row_key", "item_id", "item_key", "item_windows", (F.col("pos") - F.col("item_at.pos")).alias("offset")]
    hits = hits.repartition("doc_id", "row_key", "item_id", "item_key").dropDuplicates(["doc_id", "row_key", "item_id", "item_key", "pos", "item_at"])
    # An item has a bounded number of windows, so an alignment has.
    aligned = hits.groupBy(*pair).agg(
        F.count("*").alias("n_windows"), F.min("pos").alias("start_word"), F.array_sort(F.collect_list("item_at")).alias("at"),
        F.array_distinct(F.flatten(F.collect_list(F.filter(F.zip_with("theirs", "ours", lambda a, b: F.struct(a.alias("theirs"), b.alias("ours"))), lambda x: canonical(x["theirs"]).startswith("<"))))).alias("slots"),
    )
    # The share of the slots' values that go one to one with the text's.
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["theirs"])))
    others = F.size(F.array_distinct(F.transform("slots", lambda s: s["ours"])))
    share = F.when(F.size("slots") == 0, 1.0).otherwise(F.least(values, others) / F.size("slots"))
    none = F.lit(-2)
    start = F.struct(none.alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("words"))
    runs = F.aggregate("at", start, _longer)
    aligned = aligned.withColumn("consistent", share).withColumn("runs", runs).withColumns({"longest_run": F.col("runs.best"), "words": F.col("runs.words")})
    return aligned.where((F.col("consistent") >= CONSISTENT) & ((F.col("n_windows") >= LEAST * F.col("item_windows")) | (F.col("words") >= RUN_WORDS)))


def _verbatim(texts: DataFrame, lengths: list[int], own: Column | None = None) -> DataFrame:
    """One row for each window of `words` as they are, of every length (or of a row's `own` one): the other columns, `pos`, `n` and the window's hash `sum`."""
    rows = texts.select("*", F.posexplode("words").alias("pos", "w0"))
    at = [F.col("w0"), *[F.get("words", F.col("pos") + i) for i in range(1, max(lengths))]]
    # A length's hash tells it apart from others'.
    each = F.array(*[F.when(at[n - 1].isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *at[:n]).alias("sum"))) for n in lengths])
    kept = F.filter(each, lambda x: x.isNotNull() if own is None else x.isNotNull() & (x["n"] == own))
    rows = rows.select("*", F.explode(kept).alias("x"))
    return rows.select(*[c for c in texts.columns if c != "words"], "pos", "x.*")


def _hits(each: DataFrame, ours: Column, bench: DataFrame, few: bool) -> DataFrame:
    """The windows of texts and items that have one hash; the items' are broadcast where they are few."""
    columns = ["doc_id", "row_key", "item_id", "item_key", "item_windows", "pos", "item_at"]
    if few:
        return each.join(F.broadcast(bench), F.col("sum") == F.col("item_sum")).select(*columns, ours, "theirs")
    # A window's row takes its own words along, not the text's; a window that many texts share goes to PARTS parts.
    each = each.select("doc_id", "row_key", "pos", "sum", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(PARTS)).cast("int").alias("part"), ours)
    parted = bench.withColumn("item_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return each.join(parted, (F.col("sum") == F.col("item_sum")) & (F.col("part") == F.col("item_part"))).select(*columns, "ours", "theirs")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row (doc_id, item_id, n_windows, item_windows, longest_run, slots, consistent, start_word) for each item that a text holds, verbatim or with other numbers, names and units.

    Windows of canonical words are hash-joined with the items' windows. Matches on one alignment (the offset between text
    and item) belong together; each brings the words that stand at its place on both sides. Where the placeholders stand,
    a value of the item must always go with the same value of the text. A pair is returned if it has enough of the
    item's windows, or windows over enough of its words on end, on one alignment, with consistent slots. An item that has
    no window, being short or made of numbers and names, is looked for as written, but for case and punctuation: in whole up to eight words,
    else by windows of eight; so its renamed copies aren't found. The items' windows are broadcast while their bytes, which are counted, are few, else shuffled. Null
    and empty texts match nothing; null ids stay null; repeated rows give one pair; empty tables give no rows.
    """
    leaks = _leaks(docs, items, id_col, text_col, item_id_col, item_text_col, broadcast_bytes)
    best = F.max(F.struct("n_windows", "longest_run", (-F.col("start_word")).alias("s"), "consistent", "item_windows", F.size("slots").alias("slots"))).alias("b")
    return leaks.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_windows"), F.col("b.item_windows").cast("long").alias("item_windows"), F.col("b.longest_run").cast("long").alias("longest_run"), F.col("b.slots").cast("long").alias("slots"), F.col("b.consistent"), (-F.col("b.s")).cast("long").alias("start_word"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item.

    Rows are told apart by id and text, a null id among them: a clean row stays though another row of its id goes. Null
    and empty texts hold nothing and stay; repeated rows stay or go together; an empty table gives no rows, and without
    items every row stays.
    """
    leaks = _leaks(docs, items, id_col, text_col, item_id_col, item_text_col, broadcast_bytes).select(id_key(F.col("doc_id")).alias("id"), "row_key").distinct()
    rows = nested(docs, id_key(docs[id_col]).alias("id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("row_key"))
    return rows.join(leaks, ["id", "row_key"], "left_anti").select("row.*")


def _longer(a: Column, x: Column) -> Column:
    on = x["pos"] == a["last"] + 1
    run, first = F.when(on, a["run"] + 1).otherwise(1), F.when(on, a["first"]).otherwise(x["first"])
    return F.struct(x["pos"].alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"), first.alias("first"), F.greatest(a["words"], x["until"] - first).alias("words"))

"""Personal data and the terms that disclose it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed, heavy_keys, id_and_text, id_key, nested, spread_join
from tallyweave.llm.spans import SPAN, bound, count_of, joined, masked, matches, of_kind, ordered

#: The patterns. Each is the contract's, with starts that can't match left out and groups that don't give
#: back, so that it takes time in proportion to the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Characters of context on either side of an entity, different texts that must pair a term with it, and the share of the
#: entity's information that a term must carry to count as disclosing.
CONTEXT, SUPPORT, DISCLOSURE = 80, 3, 0.85
TERM = r"(?<![\p{L}\p{N}_@.+-])\p{L}[\p{L}\p{N}]{2,}(?![\p{L}\p{N}_@])"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a string pass the check sum that doubles every second digit from the right."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _card(whole: Column, _: Column) -> Column:
    d = digits(whole)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def _ip(whole: Column, _: Column) -> Column:
    # A part of more than three significant digits exceeds 255.
    return F.forall(F.split(whole, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    return ordered(
        matches(text, EMAIL, "email", 0),
        matches(text, IP, "ip", 1, _ip),
        matches(text, CARD, "card", 2, _card),
        matches(text, PHONE, "phone", 3, lambda whole, _: F.length(digits(whole)).between(10, 15)),
    )


def _part(text: Column, start: Column, stop: Column) -> Column:
    """The code points from start up to stop."""
    return F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))


def entity_of(text: Column, span: Column) -> Column:
    """The protected value of a span: an email in lower case, the digits of a number."""
    raw = _part(text, span["start"], span["stop"])
    return F.when(span["kind"] == "email", F.lower(raw)).otherwise(digits(raw))


def terms_near(text: Column, span: Column, context: int = CONTEXT) -> Column:
    """The terms, in lower case, that lie wholly within `context` characters of a span, on any line.

    They are looked for with one character more on either side, so that a word that the edge cuts isn't taken for a whole one.
    """
    first = F.greatest(span["start"] - context - 1, F.lit(0))
    inside = lambda s: (
        (first + s["start"] >= span["start"] - context) & (first + s["stop"] <= span["stop"] + context) & ((first + s["stop"] <= span["start"]) | (first + s["start"] >= span["stop"]))
    )
    near = lambda window: F.transform(F.filter(matches(window, TERM, "term", 9), inside), lambda s: F.lower(_part(window, s["start"], s["stop"])))
    return bound(_part(text, first, span["stop"] + context + 1), near)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, row_key, spans), spans of emails, ips, cards and phones, and of terms that disclose them.

    A protected entity is a value found (an email in lower case, the digits of a number). All counts are of rows: n(e) with
    an entity e, n(e, t) with a term t within `CONTEXT` characters of e, n(t) with t as a term anywhere (parts of addresses are none), and N. The term's information
    on the entity, log(N n(e,t) / (n(e) n(t))), is compared with the entity's own, log(N / n(e)); from `DISCLOSURE` of it on,
    seen in `SUPPORT` different texts or more, every place of the term in a text that holds the entity becomes a span of
    kind "term". Copies count in all four alike. Counts are summed before they are shuffled, and no entity's or term's rows
    meet in one task unsummed; texts are read twice, for the entities and for the words, and only those with an entity are
    kept between. Null and empty texts have no spans; a null id stays null; repeated rows each get their row; an empty
    table gives no rows.
    """
    rows = id_and_text(df, id_col, text_col)
    text, spans = F.col("text"), F.col("spans")
    found = rows.select("doc_id", F.xxhash64("text").alias("row_key"), "text", base_spans(text).alias("spans"))
    about = F.transform(spans, lambda s: F.struct(entity_of(text, s).alias("entity"), terms_near(text, s).alias("terms")))
    found = found.select("doc_id", "row_key", "spans", F.when(F.size("spans") > 0, text).alias("text"), F.when(F.size("spans") > 0, about).alias("about"))
    found = checkpointed(found)

    seen = found.where("about is not null").select("doc_id", "row_key", "about")
    holds = seen.select("doc_id", "row_key", F.explode(F.array_distinct(F.transform("about", lambda x: x["entity"]))).alias("entity"))
    entities = checkpointed(holds.groupBy("entity").agg(F.count("*").alias("n_entity")))
    both = F.flatten(F.transform("about", lambda x: F.transform(x["terms"], lambda t: F.struct(x["entity"].alias("entity"), t.alias("term")))))
    pairs = seen.select("row_key", F.explode(F.array_distinct(both)).alias("p")).groupBy("p.entity", "p.term", "row_key").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    # The same matches as those near an entity, each lower-cased by itself: lower case can be longer, and part a word.
    words = rows.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    spread = words.groupBy("term").agg(F.count("*").alias("n_word"))
    # One row joins all: the number of rows.
    total = F.broadcast(found.agg(F.count("*").alias("n_all")))
    ratio = F.log(F.col("n_all") * F.col("n_pair") / (F.col("n_entity") * F.col("n_word"))) / F.log(F.col("n_all") / F.col("n_entity"))
    disclosing = pairs.join(entities, "entity").join(spread, "term").join(total).where((F.col("n_all") > F.col("n_entity")) & (ratio >= DISCLOSURE))
    disclosing = checkpointed(disclosing.select("entity", "term"))
    told = spread_join(holds, disclosing, "entity", "row_key", heavy_keys(entities, "entity", "n_entity"))
    told = told.groupBy(id_key(F.col("doc_id")).alias("its"), F.col("row_key").alias("its_key")).agg(F.collect_set("term").alias("terms"))
    out = found.join(told, (id_key(F.col("doc_id")) == F.col("its")) & (F.col("row_key") == F.col("its_key")), "left")
    more = F.when(F.col("terms").isNotNull(), matches(text, TERM, "term", 9, lambda whole, _: F.array_contains("terms", F.lower(whole)))).otherwise(F.array().cast(SPAN))
    return out.select("doc_id", "row_key", ordered("spans", more).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the spans of each row of `found`: zero and those of the empty string where it has none, a null id stays null."""
    spans = F.col("spans")
    return found.select("doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in BASE], F.sha2(joined(of_kind(spans, *BASE)).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def sanitise(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with personal data generalised to its kind, such as [EMAIL], and disclosing terms removed ([...]).

    Rows are told apart by id and text, a null id among them; other columns, whatever their names, and rows without spans, also null
    texts, stay as they are; repeated rows are masked alike; an empty table gives no rows.
    """
    hits = found.where(F.size("spans") > 0).groupBy(id_key(F.col("doc_id")).alias("id"), "row_key").agg(F.first("spans").alias("spans"))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = nested(df, id_key(df[id_col]).alias("id"), F.xxhash64(text).alias("row_key")).join(hits, ["id", "row_key"], "left")
    mask = lambda s: F.when(s["kind"] == "term", "[...]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    own = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNull(), own).otherwise(masked(own.cast("string"), F.col("spans"), mask))
    return rows.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])

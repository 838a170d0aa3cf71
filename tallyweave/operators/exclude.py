"""Rules that set people aside, and learning them from titles never found in the reference register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.text import first_hit, has_any, is_formal, sorted_set, title_head


def load_settings(settings: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant, titles, names, use_default) for each tenant, with defaults where nothing is saved."""
    none = F.array().cast("array<string>")
    return tenants.join(settings, "tenant", "left").select("tenant", F.coalesce("titles", none).alias("titles"), F.coalesce("names", none).alias("names"), F.coalesce("use_default", F.lit(True)).alias("use_default"))


def save_settings(settings: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """The settings after updates (tenant, titles, names, use_default): lists trimmed, distinct and sorted; a null use_default leaves the old one.

    Of several updates of a tenant the last by `order` counts, and must be the only one without it; the last use_default that isn't null stays.
    """
    if order is not None:
        of = F.coalesce(F.when(F.trim("tenant") != "", F.col("tenant")), F.lit("_default")).alias("tenant")
        given = F.when(F.col("use_default").isNotNull(), F.col(order))
        updates = updates.groupBy(of).agg(F.max_by("titles", order).alias("titles"), F.max_by("names", order).alias("names"), F.max_by("use_default", given).alias("use_default"))
    old = settings.select("tenant", F.col("titles").alias("t0"), F.col("names").alias("n0"), F.col("use_default").alias("u0"))
    new = updates.select(F.coalesce(F.when(F.trim("tenant") != "", F.col("tenant")), F.lit("_default")).alias("tenant"), sorted_set(F.col("titles")).alias("t1"), sorted_set(F.col("names")).alias("n1"), F.col("use_default").alias("u1"))
    both = old.join(new, "tenant", "full")
    return both.select("tenant", F.coalesce("t1", "t0").alias("titles"), F.coalesce("n1", "n0").alias("names"), F.coalesce("u1", "u0", F.lit(True)).alias("use_default"))


def remember(settings: DataFrame, more: DataFrame) -> DataFrame:
    """The settings with further titles and names (tenant, titles, names) put to those that are there; `changed` tells whether a tenant's lists grew.

    Several rows of a tenant are put together.
    """
    none = F.array().cast("array<string>")
    more = more.groupBy("tenant").agg(F.flatten(F.collect_list(F.coalesce("titles", none))).alias("t1"), F.flatten(F.collect_list(F.coalesce("names", none))).alias("n1"))
    old = settings.select("tenant", F.col("titles").alias("t0"), F.col("names").alias("n0"), "use_default")
    both = old.join(more, "tenant", "full").select("tenant", *[F.coalesce(c, none).alias(c) for c in ("t0", "n0", "t1", "n1")], F.coalesce("use_default", F.lit(True)).alias("use_default"))
    titles, names = sorted_set(F.concat("t0", "t1")), sorted_set(F.concat("n0", "n1"))
    changed = (titles != F.array_sort("t0")) | (names != F.array_sort("n0"))
    return both.select("tenant", titles.alias("titles"), names.alias("names"), "use_default", changed.alias("changed"))


def with_learned(settings: DataFrame, stats: DataFrame) -> DataFrame:
    """`settings` with the titles that the statistics suggest put to every tenant's own; `changed` tells where they weren't there."""
    found = learn(stats).where("verdict = 'suggest'").agg(F.collect_set("title").alias("titles"))  # one row, of titles alone
    return remember(settings, settings.select("tenant").join(F.broadcast(found)).withColumn("names", F.array().cast("array<string>")))


def by_total(stats: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Adds place, from 0: most people first, then by title; within `keys` where given."""
    order = W.partitionBy(*keys).orderBy(F.desc("total"), "title")
    return stats.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def mark(people: DataFrame, settings: DataFrame | None = None, learned: str | None = None) -> DataFrame:
    """Adds secondary and secondary_reason. `settings` is one row per batch or tenant (batch_id, titles, names, use_default); without it the default words count.

    A formal title is never set aside unless the person is named; then the first keyword of the main post is reported,
    the tenant's before the default ones; then named people. `learned` is a column with the first learned keyword of the
    main post; it counts as one of the tenant's, which are in order.
    """
    default = F.array(*[F.lit(x) for x in rules.EXCLUDED_TITLES])
    none = F.array().cast("array<string>")
    if settings is not None:
        people = people.join(settings.select("batch_id", F.col("titles").alias("__t"), F.col("names").alias("__n"), F.col("use_default").alias("__u")), "batch_id", "left")
    else:
        people = people.withColumns({"__t": none, "__n": none, "__u": F.lit(True)})
    head, title = title_head(F.col("title")), F.coalesce(F.col("title"), F.lit(""))
    named = F.array_contains(F.coalesce("__n", none), F.coalesce("name", F.lit("")))
    own = first_hit(head, F.coalesce("__t", none))
    hit = F.coalesce(own if learned is None else F.least(own, learned), F.when(F.coalesce("__u", F.lit(True)), first_hit(head, default)))
    reason = F.when(is_formal(title) & ~named, F.lit(None)).when(hit.isNotNull(), F.concat(F.lit("職稱含「"), hit, F.lit("」"))).when(named, "個別指定")
    return people.withColumn("secondary_reason", reason).withColumn("secondary", F.col("secondary_reason").isNotNull()).drop("__t", "__n", "__u")


def observe(people: DataFrame, known: DataFrame) -> DataFrame:
    """(batch_id, title, total, in_af): people of each title and how many of them the reference register names."""
    names = known.select("batch_id", "name").distinct().withColumn("__in", F.lit(True))
    rows = people.where(F.trim(F.coalesce("title", F.lit(""))) != "").join(names, ["batch_id", "name"], "left")
    return rows.groupBy("batch_id", "title").agg(F.count("*").alias("total"), F.count_if(F.coalesce("__in", F.lit(False))).alias("in_af"))


def merge(observations: DataFrame) -> DataFrame:
    """(title, total, in_af, files) over all batches; a batch counts once however often it was seen."""
    once = observations.groupBy("batch_id", "title").agg(F.max("total").alias("total"), F.max("in_af").alias("in_af"))
    return once.groupBy("title").agg(F.sum("total").alias("total"), F.sum("in_af").alias("in_af"), F.count("*").alias("files"))


def learn(stats: DataFrame, min_people: int = rules.MIN_PEOPLE, min_files: int = rules.MIN_FILES) -> DataFrame:
    """Adds verdict: "suggest" for titles never in the register though seen enough, "wrong" for titles that the default words exclude though they are in it."""
    default = has_any(title_head(F.col("title")), rules.EXCLUDED_TITLES)
    suggest = (F.col("in_af") == 0) & (F.col("total") >= min_people) & (F.col("files") >= min_files) & ~is_formal(F.col("title")) & ~default
    return stats.withColumn("verdict", F.when(suggest, "suggest").when(default & (F.col("in_af") > 0), "wrong")).where("verdict is not null")


def learned_by_batch(observations: DataFrame, order: str = "batch_ord") -> DataFrame:
    """(title, batch_ord) from which on a title is set aside: the first batch after which it is suggested, itself included; it stays so.

    `observations` has one row per title and batch (title, batch_ord, total, in_af).
    """
    upto = W.partitionBy("title").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    stats = observations.select("title", order, F.sum("total").over(upto).alias("total"), F.sum("in_af").over(upto).alias("in_af"), F.count("*").over(upto).alias("files"))
    return learn(stats).where("verdict = 'suggest'").groupBy("title").agg(F.min(order).alias(order))


def learned_spans(observations: DataFrame, order: str = "batch_ord") -> DataFrame:
    """(title, since, until): the batches after which a title is suggested, from `since` up to but without `until`, where the register first has it (null: never).

    `observations` has one row per title and batch (title, batch_ord, total, in_af). Counts only grow, so there is one span.
    """
    upto = W.partitionBy("title").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    stats = observations.select("title", order, F.sum("total").over(upto).alias("total"), F.sum("in_af").over(upto).alias("in_af"), F.count("*").over(upto).alias("files"))
    since = learn(stats).where("verdict = 'suggest'").groupBy("title").agg(F.min(order).alias("since"))
    until = observations.where("in_af > 0").groupBy("title").agg(F.min(order).alias("until"))
    return since.join(until, "title", "left")


def keywords_in(titles: DataFrame, words: DataFrame) -> DataFrame:
    """(title, head, keyword) of `titles` (title) whose main post, `head`, holds a word of `words` (keyword), once for each.

    A join on the pieces of the posts that are as long as some word, so no title meets every word.
    """
    lengths = words.agg(F.collect_set(F.length("keyword")).alias("lengths"))  # one row, of a few numbers
    heads = titles.select("title", title_head(F.col("title")).alias("head")).distinct().join(F.broadcast(lengths))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("head") - n + 1), lambda i: F.substring("head", i, n))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n.between(1, F.length("head"))), at)))
    return heads.select("title", "head", F.explode(pieces).alias("keyword")).join(words.select("keyword").distinct(), "keyword").select("title", "head", "keyword")


def learned_for(batches: DataFrame, wanted: DataFrame, spans: DataFrame) -> DataFrame:
    """(tenant, keyword, from_ord): from which of its batches on a tenant has a learned title, the first one within the title's span; it keeps it.

    `batches` (tenant, batch_ord), `wanted` (tenant, keyword) the pairs to look up. The next batch at or after a span's
    beginning is found by one sort of both, as of the beginning, and not by comparing spans with batches.
    """
    asked = wanted.distinct().join(spans.withColumnRenamed("title", "keyword"), "keyword")
    rows = asked.select("tenant", F.col("since").alias("at"), F.lit(0).alias("kind"), "keyword", "until")
    rows = rows.unionByName(batches.select("tenant", F.col("batch_ord").alias("at"), F.lit(1).alias("kind")).distinct(), allowMissingColumns=True)
    ahead = W.partitionBy("tenant").orderBy("at", "kind").rowsBetween(0, W.unboundedFollowing)
    found = rows.withColumn("from_ord", F.min(F.when(F.col("kind") == 1, F.col("at"))).over(ahead)).where("kind = 0")
    return found.where("from_ord IS NOT NULL AND (until IS NULL OR from_ord < until)").select("tenant", "keyword", "from_ord")


def mark_as_of(people: DataFrame, observations: DataFrame, batches: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """`mark` of each batch by what had been learned up to it: (…, secondary_reason, secondary).

    `observations` (batch_ord, title, total, in_af) and `batches` (batch_id, tenant, batch_ord) are of all batches there
    were; `settings` (tenant, titles, names, use_default) is what tenants had saved. A title that the observations up to a
    tenant's batch suggest goes to that tenant's own, for this batch and all its later ones; other tenants, and batches before, aren't
    touched. Batches that aren't in `batches` have nothing learned.
    """
    spans = learned_spans(observations)
    found = keywords_in(people.where("title IS NOT NULL").select("title"), spans.select(F.col("title").alias("keyword")))
    of = people.select("batch_id", "title").distinct().join(batches.select("batch_id", "tenant", "batch_ord"), "batch_id").join(found, "title")
    since = learned_for(batches, of.select("tenant", "keyword"), spans)
    first = of.join(since, ["tenant", "keyword"]).where("from_ord <= batch_ord").groupBy("batch_id", "title").agg(F.min("keyword").alias("__learned"))
    own = None if settings is None else batches.select("batch_id", "tenant").join(settings, "tenant").drop("tenant")
    return mark(people.join(first, ["batch_id", "title"], "left"), own, "__learned").drop("__learned")


def suggested_titles(people: DataFrame) -> DataFrame:
    """(batch_id, titles) per batch, in order, whose main post has a default word."""
    found = people.where(has_any(title_head(F.col("title")), rules.EXCLUDED_TITLES))
    return found.groupBy("batch_id").agg(sorted_set(F.collect_set("title")).alias("titles"))

"""Secret scans over an incremental ledger of blobs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.lineage import shared_folder
from tallyweave.llm.common import heavy_keys, id_and_text, id_key, nested, spread_join
from tallyweave.llm.spans import SPAN, count_of, joined, masked, matches, of_kind, ordered


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A changed pattern takes a new version, and blobs are scanned for it again."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


PEM_END = "-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: Header lines of an encrypted key, then all up to the END line, or, where that is missing, to the last line of base64;
#: the header alone if nothing of the kind follows. Runs of one class, so that long bodies need no stack.
PEM = (
    r"""-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\s\\nr>#*|"'+,]+[A-Z][A-Za-z0-9-]{1,40}:[^\n\\]*){0,9}"""
    rf"(?:[^-]*{PEM_END}|"
    r"""[A-Za-z0-9+/=\s\\"'>#*,|]*[\s\\"'>nr][A-Za-z0-9+/]{24,}={0,2}(?:[\r\\nr"'+]*\n[\x20\t>#*|"']*[A-Za-z0-9+/]+={0,2}(?m:$))?)?"""
)
#: Patterns and least lengths. Letters of the assigned names match in either case.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "[0-9a-f]{24,}"),  # the same matches as a run of any length that is dropped under 24
    Rule("pem", 2, PEM),
    Rule("forge", 1, "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
LEDGER = f"blob binary, rule string, spans {SPAN}"


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the text's bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(df: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, spans): one for each blob of `df` and rule version that `ledger` hasn't seen.

    Each distinct text is scanned once, in a row of its smallest id, for the rules it is due. Only ids and addresses are
    grouped; texts go once through a shuffle on (blob, id), which no group of copies makes uneven. A null text is the
    empty blob; a null id is a path like others, and a blob's smallest only where it has no other; repeated rows (same id,
    same text) are scanned once; other columns aren't read; an empty table gives no rows.
    """
    texts = id_and_text(df, id_col, text_col).select(blob_of(F.col("text")).alias("blob"), id_key(F.col("doc_id")).alias("path"), "doc_id", "text")
    owners = texts.groupBy("blob").agg(F.min("doc_id").alias("owner"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        due = owners.withColumn("due", names)
    else:
        seen = ledger.select("blob", "rule").distinct()
        due = owners.withColumn("rule", F.explode(names)).join(seen, ["blob", "rule"], "left_anti").groupBy("blob", "owner").agg(F.collect_list("rule").alias("due"))
    due = due.select("blob", id_key(F.col("owner")).alias("path"), "due")
    # Repeated rows lie together by (blob, path) already; one of them stays.
    rows = texts.select("blob", "path", "text").join(due, ["blob", "path"]).groupBy("blob", "path").agg(F.first("text").alias("text"), F.first("due").alias("due"))
    text, found = F.col("text"), []
    for rank, rule in enumerate(rules):
        holds = (lambda whole, inner, n=rule.least: F.length(inner) >= n) if rule.least else None
        spans = matches(text, rule.pattern, rule.kind, rank, holds, rule.group)
        found.append(F.struct(F.lit(rule.name).alias("rule"), F.when(F.array_contains("due", rule.name), spans).alias("spans")))
    rows = rows.select("blob", F.array(*found).alias("found"))
    return rows.select("blob", F.explode(F.filter("found", lambda x: x["spans"].isNotNull())).alias("f")).select("blob", "f.rule", "f.spans")


def ledger_folder(spark: SparkSession) -> str:
    """A new folder for a ledger among the checkpoints, which the cluster shares."""
    return f"{shared_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"


def update(df: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger table in `folder` hasn't seen of `df`, appends it there, and returns the table as it then is.

    A folder without a table is an empty ledger. A blob and rule version already in it isn't scanned again, whichever rows
    hold it now; what is appended is one commit of one job, so that a lost executor's tasks run again without doubling rows.
    """
    spark = df.sparkSession
    try:
        before = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException:  # no table yet
        before = None
    scan(df, before, rules, id_col, text_col).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def findings(df: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every row of `df`: the ledger's findings for `rules` joined back to all paths of a blob, ordered by place; none: an empty array.

    The paths of a blob of many copies are dealt out further. Null ids and null texts (the empty blob) and repeated rows each get their row;
    an empty table gives no rows.
    """
    paths = id_and_text(df, id_col, text_col).select("doc_id", id_key(F.col("doc_id")).alias("path"), blob_of(F.col("text")).alias("blob"))
    names = [r.name for r in rules]
    hits = ledger.where((F.size("spans") > 0) & F.col("rule").isin(names)).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    many = heavy_keys(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob", "n")
    return spread_join(paths, hits, "blob", "path", many, "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds and digests of the findings of each row of `found`: zero and those of the empty string where it has none, a null id stays null."""
    spans = F.col("spans")
    counts = [count_of(spans, kind).alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(joined(of_kind(spans, *base)).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with every secret replaced by [SECRET].

    Rows are told apart by id and text, a null id among them; other columns, whatever their names, and rows without
    findings, also null texts, stay as they are; repeated rows are masked alike; an empty table gives no rows.
    """
    hits = found.where(F.size("spans") > 0).groupBy(id_key(F.col("doc_id")).alias("path"), "blob").agg(F.first("spans").alias("spans"))
    rows = nested(df, id_key(df[id_col]).alias("path"), blob_of(F.coalesce(df[text_col].cast("string"), F.lit(""))).alias("blob")).join(hits, ["path", "blob"], "left")
    own = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNull(), own).otherwise(masked(own.cast("string"), F.col("spans"), lambda s: F.lit("[SECRET]")))
    return rows.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])

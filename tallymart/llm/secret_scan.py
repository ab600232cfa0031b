"""Secret scans over an incremental, content-addressed blob ledger.

Every version of a text is addressed by its SHA-256. A blob is scanned once for each version of the rules: the ledger keeps
(blob, rules) pairs, findings are kept by blob, and both are joined back to all paths that hold the blob. Texts are shuffled
once, reduced to one copy of each blob within every task before that, so a text that a third of all paths share is no hot key.

The ledger is two append-only Parquet tables, ``findings`` and ``scanned``, below one folder. Findings are written first: a run
that breaks off in between is repeated, and repeated findings are dropped when they are read.

Positions are code points, ends exclusive. Null texts count as empty. Repeated rows and ties give repeated results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import marked, settle, shared_path


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern``, of which those stay whose ``group`` has ``least`` characters.

    ``hint``: a string that every match holds; texts without it are not searched.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str = ""


#: The base rules, in their order, and the rules that this scanner adds. Long runs are asked for in the pattern
#: where that finds the same matches.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, "AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 21, "eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27, "-----BEGIN "),
)
RULES = BASE + ADDED
#: To be raised with every change of the rules; blobs are then scanned again.
RULES_VERSION = 1

FINDINGS = "blob string, rules int, kind string, kind_no int, start long, end long"
SCANNED = "blob string, rules int"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Arrays of the matched strings and of the strings between them, one struct for each rule."""
    nothing = F.array().cast("array<string>")

    def one(no: int, rule: Rule) -> Column:
        there = F.contains(text, F.lit(rule.hint)) if rule.hint else text.rlike(rule.pattern)
        found = F.when(there, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(nothing)
        between = F.when(there, F.split(text, rule.pattern, -1)).otherwise(nothing)
        return F.struct(F.lit(no).alias("no"), found.alias("found"), between.alias("between"))

    return F.array(*[one(no, rule) for no, rule in enumerate(rules)])


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """Findings of ``blobs`` (blob, text): a match starts where the texts between and the matches before it end."""
    by_rule = blobs.select("blob", F.explode(_matches(F.col("text"), rules)).alias("r")).where(F.size("r.found") > 0)
    each = by_rule.select("blob", "r.no", F.posexplode(F.arrays_zip("r.found", F.slice("r.between", 1, F.size("r.found")).alias("between"))).alias("at", "m"))
    each = each.select("blob", "no", "at", F.col("m.found").alias("found"), F.length("m.found").cast("long").alias("own"), F.length("m.between").cast("long").alias("gap"))
    end = F.sum(F.col("own") + F.col("gap")).over(W.partitionBy("blob", "no").orderBy("at"))
    grouped = F.lit(False)
    for no, rule in enumerate(rules):
        part = F.regexp_extract("found", rule.pattern, rule.group) if rule.group else F.col("found")
        grouped = F.when(F.col("no") == no, F.length(part) >= rule.least).otherwise(grouped)
    each = each.withColumn("good", grouped).drop("found").withColumn("end", end).where("good")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return each.select("blob", F.lit(version).alias("rules"), F.get(kinds, F.col("no")).alias("kind"), F.col("no").alias("kind_no"), (F.col("end") - F.col("own")).alias("start"), "end")


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def update(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """Scan the blobs of ``versions`` that ``ledger`` has not seen under these rules; returns all findings of these rules."""
    spark = versions.sparkSession
    known = _kept(spark, f"{ledger}/scanned", SCANNED).where(F.col("rules") == version).select("blob").distinct()
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(known, "blob", "left_anti")
    scan(unseen, rules, version).write.mode("append").parquet(f"{ledger}/findings")
    fresh = versions.select(blob_of(F.col(text)).alias("blob")).distinct().join(known, "blob", "left_anti")
    fresh.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    return _kept(spark, f"{ledger}/findings", FINDINGS).where(F.col("rules") == version).distinct()


def _none() -> Column:
    return F.array().cast("array<struct<start:long,kind_no:int,kind:string,end:long>>")


def _spans(docs: DataFrame, ledger: str | None, text: str, rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """(blob, spans) of the blobs of ``docs`` with findings."""
    findings = update(docs, ledger or shared_path(docs.sparkSession, "ledger"), text, rules, version)
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("spans"))


def find(docs: DataFrame, ledger: str | None = None, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """``docs`` as doc (struct of the columns ``keep``, all by default) with spans: array of (start, kind_no, kind, end) in that
    order, empty if none. What ``keep`` names is shuffled to the findings; leave the text out where it is not needed.

    ``ledger``: folder of the ledger, kept between calls; without one, a fresh one in the shared folder.
    """
    spans = _spans(docs, ledger, text, rules, version)
    paths = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), blob_of(F.col(text)).alias("blob"))
    return paths.join(spans, "blob", "left").select("doc", "blob", F.coalesce("spans", _none()).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ledger: str | None = None, **how) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans by one. Other columns stay.

    Documents without findings, but for a few that a bitmap of blobs cannot tell from others, are not shuffled.
    """
    spans_of = settle(_spans(docs, ledger, text, **how), "secret-spans")
    paths = docs.select(F.struct("*").alias("doc"), blob_of(F.col(text)).alias("blob"))
    told = marked(paths, F.xxhash64("blob"), spans_of.select(F.xxhash64("blob").alias("key")))
    found = told.where("likely").select("row.*").join(spans_of, "blob", "left").select("doc", F.coalesce("spans", _none()).alias("spans"))
    body, spans = F.col(f"doc.{text}"), F.col("spans")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.when(span.start >= done.at, F.concat(F.substring(body, (done.at + 1).cast("int"), (span.start - done.at).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(done.at, span.end).alias("at"), F.concat(done.out, gap).alias("out"))

    whole = lambda done: F.concat(done.out, F.substring(body, (done.at + 1).cast("int"), F.length(body)))
    clean = F.when(F.size(spans) == 0, body).otherwise(F.aggregate(spans, start, step, whole))
    changed = found.select(F.col("doc").withField(text, clean).alias("doc"))
    return told.where("NOT likely").select("row.doc").unionByName(changed).select("doc.*")

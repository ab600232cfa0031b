"""Match types, match keys, statistics, report keys and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Report codes, statistics, and the statistic that counts each match type.
DSS, CSS, ESB, ERB = "DSS", "CSS", "ESB", "ERB"
STATISTICS = (
    "ENTITY_COUNT",
    "UNMATCHED_COUNT",
    "MATCHED_COUNT",
    "AMBIGUOUS_MATCH_COUNT",
    "POSSIBLE_MATCH_COUNT",
    "DISCLOSED_RELATION_COUNT",
    "POSSIBLE_RELATION_COUNT",
)
MATCH_TYPES = ("AMBIGUOUS_MATCH", "POSSIBLE_MATCH", "DISCLOSED_RELATION", "POSSIBLE_RELATION")


def statistic_of(match_type: Column) -> Column:
    """The statistic that counts relations of a match type."""
    return F.concat(match_type, F.lit("_COUNT"))


def classify_match(is_ambiguous: Column, is_disclosed: Column, level_code: Column) -> Column:
    """Match type of a relation: ambiguity first, then disclosure, then the match level; null flags count as unset."""
    set_ = lambda c: F.coalesce(c, F.lit(0)) != 0
    return (
        F.when(set_(is_ambiguous), "AMBIGUOUS_MATCH").when(set_(is_disclosed), "DISCLOSED_RELATION").when(level_code == "POSSIBLY_SAME", "POSSIBLE_MATCH").otherwise("POSSIBLE_RELATION")
    )


def trimmed(text: Column) -> Column:
    """Text without leading and trailing characters up to U+0020."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalise_blank(text: Column) -> Column:
    """:func:`trimmed` text; null where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


#: A component of a match key (sign, then escaped or plain characters up to the next sign), and one that carries two roles.
COMPONENT = r"(?s)[+-]?(?:\\.|\\$|[^\\+\-])*"
ROLES = r"(?s)^((?:\\.|[^\\(])*(?:\\\S|[^\\(\s]))\(((?:\\.|[^\\:)])*):((?:\\.|[^\\:)])*)\)(.*)$"


def reverse_match_key(key: Column) -> Column:
    """The match key seen from the other side: both roles swapped in every component that has exactly two. Null stays null,
    a blank key stays as it is, others are trimmed."""
    parts = F.regexp_extract_all(trimmed(key), F.lit(COMPONENT), F.lit(0))
    swapped = F.array_join(F.transform(parts, lambda c: F.regexp_replace(c, ROLES, "$1($3:$2)$4")), "")
    return F.when(trimmed(key) == "", key).otherwise(swapped)


def format_statistic(base: Column, match_key: Column, principle: Column) -> Column:
    """``STAT[:principle[:matchKey]]``; the principle is empty where only the key is given."""
    tail = F.when(match_key.isNotNull(), F.concat(F.lit(":"), F.coalesce(principle, F.lit("")), F.lit(":"), match_key))
    return F.concat(base, F.coalesce(tail, F.concat(F.lit(":"), principle), F.lit("")))


def parse_statistic(text: Column) -> Column:
    """Struct (statistic, principle, match_key); the key may hold colons, empty parts are null."""
    parts = F.split(text, ":", 3)
    part = lambda i: normalise_blank(F.get(parts, F.lit(i)))
    return F.struct(F.get(parts, F.lit(0)).alias("statistic"), part(1).alias("principle"), part(2).alias("match_key"))


def encode_report_key(report: Column, statistic: Column, source1: Column, source2: Column) -> Column:
    """``CODE:statistic[:source1[:source2]]``, parts form-encoded. A second source without a first is an error."""
    wrong = F.raise_error(F.lit("a second data source needs a first")).cast("string")
    tail = F.when(source1.isNotNull(), F.concat(F.lit(":"), F.url_encode(source1), F.coalesce(F.concat(F.lit(":"), F.url_encode(source2)), F.lit(""))))
    tail = F.when(source1.isNull() & source2.isNotNull(), wrong).otherwise(F.coalesce(tail, F.lit("")))
    return F.concat(report, F.lit(":"), F.url_encode(statistic), tail)


def decode_report_key(key: Column) -> Column:
    """Struct (report, statistic, source1, source2); keys of other than two to four parts are an error."""
    parts = F.split(key, ":")
    checked = F.when(F.size(parts).between(2, 4), parts).otherwise(F.raise_error(F.concat(F.lit("malformed report key: "), key)).cast("array<string>"))
    part = lambda i: F.url_decode(F.get(checked, F.lit(i)))
    return F.struct(F.get(checked, F.lit(0)).alias("report"), part(1).alias("statistic"), part(2).alias("source1"), part(3).alias("source2"))


def orient_relations(relations: DataFrame) -> DataFrame:
    """Undirected pairs, lower id first, of directed ``relations`` (entity_id, related_id, match_type, match_key, errule_code).

    Keys follow the direction: forward is the key from the lower to the higher id. Only disclosed relations have a reverse key
    that differs.
    """
    flipped = F.col("entity_id") > F.col("related_id")
    other = F.when(F.col("match_type") == "DISCLOSED_RELATION", reverse_match_key(F.col("match_key"))).otherwise(F.col("match_key"))
    keyed = relations.withColumn("other_key", other)
    return keyed.select(
        F.least("entity_id", "related_id").alias("entity_id"), F.greatest("entity_id", "related_id").alias("related_id"), "match_type",
        F.when(flipped, F.col("other_key")).otherwise(F.col("match_key")).alias("match_key"),
        F.when(flipped, F.col("match_key")).otherwise(F.col("other_key")).alias("rev_match_key"), "errule_code",
    ).dropDuplicates(["entity_id", "related_id"])


def directed(relations: DataFrame) -> DataFrame:
    """Both directions of undirected ``relations``; each direction has the key that its own entity sees."""
    columns = ["entity_id", "related_id", "match_type", "match_key", "rev_match_key", "errule_code"]
    back = relations.select(
        F.col("related_id").alias("entity_id"), F.col("entity_id").alias("related_id"), "match_type", F.col("rev_match_key").alias("match_key"), F.col("match_key").alias("rev_match_key"), "errule_code"
    )
    return relations.select(*columns).union(back)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts joined by U+001F; nulls are marked, so they differ from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts]), 256)

"""Report queries. They read the pre-aggregated ``report`` table; lists read ``report_detail`` through keyset pages.

``sources``: a DataFrame with data_source of further configured sources, which appear with zeros. Match key and principle: null
for the rows without one, ``*`` for all rows, else equality; blank counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import CSS, DSS, ERB, ESB, parse_statistic
from ..operators.paging import Page, ReportKey, entities_page, page, relations_page
from .mart import Mart

#: The counts of a cross-source summary, in their order, and the names of lists by kind.
KINDS = ("MATCHED_COUNT", "AMBIGUOUS_MATCH_COUNT", "POSSIBLE_MATCH_COUNT", "POSSIBLE_RELATION_COUNT", "DISCLOSED_RELATION_COUNT")
DEFAULT_SOURCES = ("TEST", "SEARCH")


def seed_sources(spark: SparkSession, names: list[str], defaults: bool = False) -> DataFrame:
    """(data_source) of configured sources; the built-in ones are left out unless asked for."""
    kept = sorted({n for n in names if defaults or n not in DEFAULT_SOURCES})
    return spark.createDataFrame([(n,) for n in kept], "data_source string")


def _blank(text: str | None) -> str | None:
    return text.strip() or None if text is not None else None


def _with(found: DataFrame, sources: DataFrame | None) -> DataFrame:
    """``found`` (data_source) with further sources."""
    return found if sources is None else found.union(sources.select("data_source")).distinct()


def loaded_sources(report: DataFrame) -> DataFrame:
    """(data_source) of the sources that have records."""
    return report.where((F.col("report") == DSS) & (F.col("statistic") == "ENTITY_COUNT") & (F.col("record_count") > 0)).select(F.col("source1").alias("data_source")).distinct()


def source_counts(report: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(data_source, entity_count, record_count, unmatched_count) by source, sorted."""
    rows = report.where((F.col("report") == DSS) & F.col("statistic").isin("ENTITY_COUNT", "UNMATCHED_COUNT"))
    of = lambda stat, c: F.coalesce(F.sum(F.when(F.col("statistic") == stat, F.col(c))), F.lit(0).cast("long"))
    each = rows.groupBy(F.col("source1").alias("data_source")).agg(
        of("ENTITY_COUNT", "entity_count").alias("entity_count"), of("ENTITY_COUNT", "record_count").alias("record_count"), of("UNMATCHED_COUNT", "entity_count").alias("unmatched_count")
    )
    if sources is not None:
        each = _with(each.select("data_source"), sources).join(each, "data_source", "left").na.fill(0)
    return each.orderBy("data_source")


def loaded_stats(report: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`source_counts` after one with the totals (data_source null); entities are totalled over ESB."""
    each = source_counts(report, sources)
    entities = report.where(F.col("report") == ESB).agg(F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entity_count"))
    sums = each.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), F.coalesce(F.sum("unmatched_count"), F.lit(0)).alias("unmatched_count"))
    total = entities.join(sums, how="inner").select(F.lit(None).cast("string").alias("data_source"), "entity_count", "record_count", "unmatched_count")
    return total.unionByName(each).orderBy(F.col("data_source").asc_nulls_first())


def source_loaded_stats(report: DataFrame, data_source: str) -> DataFrame:
    """One row of counts for a source, zeros if it is absent."""
    one = report.sparkSession.createDataFrame([(data_source,)], "data_source string")
    return one.join(source_counts(report.where(F.col("source1") == data_source)), "data_source", "left").na.fill(0)


def _breakdown(report: DataFrame, code: str, name: str) -> DataFrame:
    rows = report.where((F.col("report") == code) & (F.col("entity_count") > 0))
    return rows.select(F.col("statistic").cast("int").alias(name), "entity_count").orderBy(F.col(name).desc())


def _one(report: DataFrame, code: str, name: str, n: int) -> DataFrame:
    count = F.coalesce(F.sum("entity_count"), F.lit(0).cast("long"))
    return report.where((F.col("report") == code) & (F.col("statistic") == str(n))).agg(count.alias("entity_count")).select(F.lit(n).alias(name), "entity_count")


def size_breakdown(report: DataFrame) -> DataFrame:
    """(entity_size, entity_count), largest size first."""
    return _breakdown(report, ESB, "entity_size")


def size_count(report: DataFrame, size: int) -> DataFrame:
    return _one(report, ESB, "entity_size", size)


def relations_breakdown(report: DataFrame) -> DataFrame:
    """(relations_count, entity_count), most relations first."""
    return _breakdown(report, ERB, "relations_count")


def relations_count(report: DataFrame, relations: int) -> DataFrame:
    return _one(report, ERB, "relations_count", relations)


def _wanted(column: Column, asked: str | None) -> Column:
    asked = _blank(asked)
    return F.lit(True) if asked == "*" else column.eqNullSafe(F.lit(asked).cast("string"))


def cross_rows(report: DataFrame, match_key: str | None = None, principle: str | None = None, kind: str | None = None) -> DataFrame:
    """(source1, source2, statistic, match_key, principle, entity_count, record_count, relation_count) of all source pairs;
    rows whose counts are all zero are left out."""
    rows = report.where(F.col("report").isin(DSS, CSS) & ~F.col("statistic").isin("ENTITY_COUNT", "UNMATCHED_COUNT"))
    rows = rows.where("entity_count <> 0 OR record_count <> 0 OR relation_count <> 0").withColumn("p", parse_statistic(F.col("statistic")))
    rows = rows.where((F.col("p.statistic") == kind) if kind else F.col("p.statistic").isin(*KINDS))
    rows = rows.where(_wanted(F.col("p.match_key"), match_key) & _wanted(F.col("p.principle"), principle))
    return rows.select("source1", "source2", "p.*", "entity_count", "record_count", "relation_count")


def _zero_filled(rows: DataFrame, pairs: DataFrame, kinds: tuple[str, ...], match_key: str | None, principle: str | None) -> DataFrame:
    """``rows`` of ``pairs`` with a zero row for each pair and kind that has none."""
    asked = lambda t: None if _blank(t) == "*" else _blank(t)
    slots = pairs.select("source1", "source2", F.explode(F.array(*map(F.lit, kinds))).alias("statistic"))
    joined = slots.join(rows.withColumn("there", F.lit(True)), ["source1", "source2", "statistic"], "left")
    for name, value in (("match_key", match_key), ("principle", principle)):
        joined = joined.withColumn(name, F.when(F.col("there"), F.col(name)).otherwise(F.lit(asked(value)).cast("string")))
    return joined.drop("there").na.fill(0, ["entity_count", "record_count", "relation_count"])


def cross_summary(report: DataFrame, source1: str, source2: str, match_key: str | None = None, principle: str | None = None, kind: str | None = None) -> DataFrame:
    """Counts of two sources against each other (of one source within itself if they are the same), sorted by kind, key and
    principle, nulls first; ``kind`` restricts them to one of ``KINDS``."""
    pair = report.sparkSession.createDataFrame([(source1, source2)], "source1 string, source2 string")
    rows = cross_rows(report.where((F.col("source1") == source1) & (F.col("source2") == source2)), match_key, principle, kind)
    filled = _zero_filled(rows, pair, (kind,) if kind else KINDS, match_key, principle)
    return filled.orderBy("statistic", F.col("match_key").asc_nulls_first(), F.col("principle").asc_nulls_first())


def _summaries(report: DataFrame, own: DataFrame, others: DataFrame, match_key: str | None, principle: str | None) -> DataFrame:
    """Cross summaries of each source of ``own`` against ``others``; both hold configured or loaded sources only."""
    # The pairs are the result's own grid: one row for each pair of sources. The second sources are one array, a few names.
    names = others.agg(F.array_sort(F.collect_set("data_source")).alias("names"))
    pairs = own.join(F.broadcast(names), how="inner").select(F.col("data_source").alias("source1"), F.explode("names").alias("source2"))
    filled = _zero_filled(cross_rows(report, match_key, principle), pairs, KINDS, match_key, principle)
    counts = source_counts(report).select(F.col("data_source").alias("source1"), F.col("entity_count").alias("source_entities"), F.col("record_count").alias("source_records"), F.col("unmatched_count").alias("source_unmatched"))
    return filled.join(counts, "source1", "left").na.fill(0, ["source_entities", "source_records", "source_unmatched"])


def source_summary(report: DataFrame, data_source: str, match_key: str | None = None, principle: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """One source against every loaded or given source, with its own counts on each row."""
    own = report.sparkSession.createDataFrame([(data_source,)], "data_source string")
    return _summaries(report, own, _with(loaded_sources(report), sources), match_key, principle)


def summary_stats(report: DataFrame, match_key: str | None = None, principle: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Every loaded or given source against every other and itself."""
    every = _with(loaded_sources(report), sources)
    return _summaries(report, every, every, match_key, principle)


def list_key(source1: str, source2: str, kind: str, match_key: str | None = None, principle: str | None = None) -> ReportKey:
    """Report key of a list; in lists ``*``, like blank, means no key or principle."""
    key, rule = (None if _blank(t) == "*" else _blank(t) for t in (match_key, principle))
    statistic = f"{kind}:{rule or ''}:{key}" if key else f"{kind}:{rule}" if rule else kind
    return ReportKey(DSS if source1 == source2 else CSS, statistic, source1, source2)


def source_entities(mart: Mart, data_source: str, p: Page | None = None, lists: bool = True) -> DataFrame:
    """Entities that have records of a source."""
    return entities_page(mart.report_detail, mart.entity, mart.record, list_key(data_source, data_source, "ENTITY_COUNT"), p, lists)


def size_entities(mart: Mart, size: int, p: Page | None = None) -> DataFrame:
    if size < 1:
        raise ValueError(f"an entity has one record at least: {size}")
    return entities_page(mart.report_detail, mart.entity, mart.record, ReportKey(ESB, str(size)), p)


def relations_entities(mart: Mart, relations: int, p: Page | None = None) -> DataFrame:
    if relations < 0:
        raise ValueError(f"a number of relations is not negative: {relations}")
    return entities_page(mart.report_detail, mart.entity, mart.record, ReportKey(ERB, str(relations)), p)


def cross_entities(mart: Mart, source1: str, source2: str, kind: str, match_key: str | None = None, principle: str | None = None, p: Page | None = None) -> DataFrame:
    """Entities behind a count of two sources, or of one within itself."""
    return entities_page(mart.report_detail, mart.entity, mart.record, list_key(source1, source2, kind, match_key, principle), p)


def summary_entities(mart: Mart, data_source: str, kind: str, match_key: str | None = None, principle: str | None = None, p: Page | None = None) -> DataFrame:
    return cross_entities(mart, data_source, data_source, kind, match_key, principle, p)


def cross_relations(mart: Mart, source1: str, source2: str, kind: str, match_key: str | None = None, principle: str | None = None, p: Page | None = None) -> DataFrame:
    """Pairs behind a relation count of two sources."""
    key = list_key(source1, source2, kind, match_key, principle)
    return relations_page(mart.report_detail, mart.entity, mart.record, mart.relation, key, p or page(pairs=True))


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON, null fields left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))

"""What one entity adds to the reports. A rebuild sums contributions; a change is the new ones minus the old ones.

States are records (entity_id, data_source, record_id, match_key, errule_code) and directed relations (entity_id, related_id,
match_type, match_key, rev_match_key, errule_code). A contribution row is (report, statistic, source1, source2, entity_id,
related_id, entities, records, relations); related_id is 0 at entity level.

Fan-out stays with the entity: records are reduced to source counts and distinct variants (:func:`summary`), relations get the
sources of the other side (:func:`linked`), and all statistics start from these. :func:`contributions` deals these few rows by entity
before they fan out; joins, distinct rows and sums by entity, also those that follow on the union of all parts, then move no row again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import CSS, DSS, ERB, ESB, format_statistic, statistic_of
from ..scratch import settle
from ..sources.snapshots import source_summary

COLUMNS = ("report", "statistic", "source1", "source2", "entity_id", "related_id", "entities", "records", "relations")
#: What all contributions consist of: entities of each source, those of one record, matches within and across sources, relations by entity and
#: by pair, entities by size and by number of relations.
PARTS = ("entities", "unmatched", "matched", "cross_matched", "related", "related_pairs", "sizes", "links")


def _rows(df: DataFrame, report: Column | str, statistic: Column, source1: Column, source2: Column, related_id: Column | int = 0, entities: Column | int = 0, records: Column | int = 0, relations: Column | int = 0) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    number = lambda v: lit(v).cast("long")
    return df.select(
        lit(report).alias("report"), statistic.alias("statistic"), source1.cast("string").alias("source1"), source2.cast("string").alias("source2"), F.col("entity_id"), number(related_id).alias("related_id"),
        number(entities).alias("entities"), number(records).alias("records"), number(relations).alias("relations"),
    )


class Summary(NamedTuple):
    """What the statistics need to know of records: (entity_id, data_source, records) and (entity_id, match_key, principle)."""

    sources: DataFrame
    variants: DataFrame


def summary(records: DataFrame | Summary) -> Summary:
    """Records reduced to source counts and variants; a summary stays as it is."""
    return records if isinstance(records, Summary) else Summary(source_summary(records), match_pair_variants(records))


def match_pair_variants(records: DataFrame) -> DataFrame:
    """(entity_id, match_key, principle): the pairs, with wildcards as nulls, under which an entity's matches are counted."""
    key, rule = F.col("match_key"), F.col("errule_code")
    none = F.lit(None).cast("string")
    pair = lambda k, p: F.struct(k.alias("match_key"), p.alias("principle"))
    pairs = F.array(
        pair(none, none), F.when(key.isNotNull(), pair(key, none)), F.when(rule.isNotNull(), pair(none, rule)), F.when(key.isNotNull() & rule.isNotNull(), pair(key, rule))
    )
    return records.select("entity_id", F.explode(F.array_compact(pairs)).alias("v")).select("entity_id", "v.*").distinct()


def relation_variants(relations: DataFrame) -> DataFrame:
    """(entity_id, related_id, match_type, match_key, principle): the variants under which each directed relation is counted.
    A reverse key that differs from the key counts too; a missing key or rule gives no variant of its own."""
    return relations.select("entity_id", "related_id", "match_type", F.explode(_pairs()).alias("v")).select("entity_id", "related_id", "match_type", "v.*")


def _pairs() -> Column:
    """Distinct pairs of key and principle of a relation, with wildcards as nulls."""
    none = F.lit(None).cast("string")
    key, back, rule = F.col("match_key"), F.col("rev_match_key"), F.col("errule_code")
    pair = lambda k, p: F.struct(k.alias("match_key"), p.alias("principle"))
    return F.array_distinct(F.array(*[pair(k, p) for k in (none, key, back) for p in (none, rule)]))


def related_sources(relations: DataFrame, records: DataFrame | Summary) -> DataFrame:
    """(entity_id, related_id, source2): the data sources of each related entity."""
    theirs = summary(records).sources.select(F.col("entity_id").alias("related_id"), F.col("data_source").alias("source2"))
    return relations.select("entity_id", "related_id").distinct().join(theirs, "related_id").select("entity_id", "related_id", "source2")


def linked(relations: DataFrame, records: DataFrame | Summary) -> DataFrame:
    """Directed relations with the data sources of the related entity (``theirs``, array of source2); those of entities without records
    go. Relations that have them stay as they are."""
    if "theirs" in relations.columns:
        return relations
    sets = summary(records).sources.groupBy(F.col("entity_id").alias("related_id")).agg(F.collect_list(F.struct(F.col("data_source").alias("source2"))).alias("theirs"))
    return relations.join(sets, "related_id").select("entity_id", "related_id", "match_type", "match_key", "rev_match_key", "errule_code", "theirs")


def _link_variants(links: DataFrame) -> DataFrame:
    """A row for each variant of ``links`` and each source of the other side."""
    kept = [c for c in links.columns if c not in ("match_key", "rev_match_key", "errule_code", "theirs")]
    each = links.select(*kept, "theirs", F.explode(_pairs()).alias("v")).select(*kept, "theirs", "v.*")
    return each.select(*kept, "match_key", "principle", F.inline("theirs"))


def _own(records: DataFrame | Summary) -> DataFrame:
    return summary(records).sources.withColumnRenamed("data_source", "source1")


def source_pairs(relations: DataFrame, records: DataFrame | Summary, around: DataFrame | Summary | None = None) -> DataFrame:
    """(entity_id, related_id, source1, source2, records): own sources against those of each related entity, directed."""
    theirs = related_sources(relations, records if around is None else around)
    return theirs.join(_own(records), "entity_id").select("entity_id", "related_id", "source1", "source2", "records")


def entity_counts_by_source(records: DataFrame | Summary) -> DataFrame:
    """DSS ENTITY_COUNT: entities and records of each source."""
    s = F.col("data_source")
    return _rows(summary(records).sources, DSS, F.lit("ENTITY_COUNT"), s, s, entities=1, records=F.col("records"))


def _totals(records: DataFrame | Summary) -> DataFrame:
    """(entity_id, n, data_source): records of each entity, and its least source."""
    return summary(records).sources.groupBy("entity_id").agg(F.sum("records").alias("n"), F.min("data_source").alias("data_source"))


def unmatched(records: DataFrame | Summary) -> DataFrame:
    """DSS UNMATCHED_COUNT: entities of one record."""
    s = F.col("data_source")
    return _rows(_totals(records).where("n = 1"), DSS, F.lit("UNMATCHED_COUNT"), s, s, entities=1, records=1)


def _matched() -> Column:
    return format_statistic(F.lit("MATCHED_COUNT"), F.col("match_key"), F.col("principle"))


def matched(records: DataFrame | Summary) -> DataFrame:
    """DSS MATCHED_COUNT: sources with several records in one entity, all of them counted under each variant."""
    sources, variants = summary(records)
    s = F.col("data_source")
    return _rows(sources.where("records > 1").join(variants, "entity_id"), DSS, _matched(), s, s, entities=1, records=F.col("records"))


def cross_matched(records: DataFrame | Summary) -> DataFrame:
    """CSS MATCHED_COUNT: ordered pairs of different sources in one entity; records are those of the first."""
    own = _own(records)
    other = own.select("entity_id", F.col("source1").alias("source2"))
    pairs = own.join(other, "entity_id").where("source1 <> source2").join(summary(records).variants, "entity_id")
    return _rows(pairs, CSS, _matched(), F.col("source1"), F.col("source2"), entities=1, records=F.col("records"))


def _related(pairs: DataFrame) -> tuple[Column, Column]:
    statistic = format_statistic(statistic_of(F.col("match_type")), F.col("match_key"), F.col("principle"))
    return F.when(F.col("source1") == F.col("source2"), DSS).otherwise(CSS), statistic


def relation_entities(relations: DataFrame, records: DataFrame | Summary, around: DataFrame | Summary | None = None) -> DataFrame:
    """DSS and CSS relation statistics at entity level: an entity counts once for each source pair and variant."""
    links = linked(relations, records if around is None else around).drop("related_id")
    pairs = _link_variants(links).distinct().join(_own(records), "entity_id")
    report, statistic = _related(pairs)
    return _rows(pairs, report, statistic, F.col("source1"), F.col("source2"), entities=1, records=F.col("records"))


def relation_pairs(relations: DataFrame, records: DataFrame | Summary, around: DataFrame | Summary | None = None) -> DataFrame:
    """DSS and CSS relation statistics at pair level: each direction of a relation, for each source pair and variant."""
    links = linked(relations, records if around is None else around)
    pairs = _link_variants(links.join(_own(records).drop("records"), "entity_id"))
    report, statistic = _related(pairs)
    return _rows(pairs, report, statistic, F.col("source1"), F.col("source2"), related_id=F.col("related_id"), relations=1)


def sizes(records: DataFrame | Summary) -> DataFrame:
    """ESB: entities by number of records."""
    none = F.lit(None)
    return _rows(_totals(records), ESB, F.col("n").cast("string"), none, none, entities=1)


def relation_counts(relations: DataFrame, records: DataFrame | Summary) -> DataFrame:
    """ERB: entities by number of relations, those without any included."""
    none = F.lit(None)
    links = relations.groupBy("entity_id").agg(F.count("*").alias("links"))
    counted = summary(records).sources.select("entity_id").distinct().join(links, "entity_id", "left").na.fill(0, ["links"])
    return _rows(counted, ERB, F.col("links").cast("string"), none, none, entities=1)


def contributions(records: DataFrame, relations: DataFrame, around: DataFrame | None = None, parts: Sequence[str] = PARTS) -> DataFrame:
    """All contributions of the entities of ``records``, or those of some ``parts`` alone; ``around``: records of the related entities,
    if others hold them too. What several parts start from is settled."""
    kept = settle if len(parts) > 1 else lambda rows, name: rows
    # A fixed number: by their size before the fan-out the tasks would be put together into a few.
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_entity = lambda rows: rows.repartition(tasks, "entity_id")
    sources, variants = summary(records)
    some = kept(sources, "summary")
    own = Summary(by_entity(some), by_entity(kept(variants, "summary")) if {"matched", "cross_matched"} & set(parts) else variants)
    links = relations
    if {"related", "related_pairs"} & set(parts):
        theirs = Summary(some, variants) if around is None else Summary(kept(source_summary(around), "summary-around"), variants)
        links = by_entity(kept(linked(relations, theirs), "links"))
    made = {
        "entities": lambda: entity_counts_by_source(own), "unmatched": lambda: unmatched(own), "matched": lambda: matched(own), "cross_matched": lambda: cross_matched(own),
        "related": lambda: relation_entities(links, own), "related_pairs": lambda: relation_pairs(links, own), "sizes": lambda: sizes(own),
        "links": lambda: relation_counts(by_entity(relations.select("entity_id")), own),
    }
    return reduce(DataFrame.unionAll, [made[name]() for name in parts])


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """New minus old contributions, zero sums left out."""
    minus = old.select(*COLUMNS[:6], *[(-F.col(c)).alias(c) for c in COLUMNS[6:]])
    sums = new.unionAll(minus).groupBy(*COLUMNS[:6]).agg(*[F.sum(c).alias(c) for c in COLUMNS[6:]])
    return sums.where("entities <> 0 OR records <> 0 OR relations <> 0")


def contribution_deltas(old: tuple[DataFrame, ...], new: tuple[DataFrame, ...]) -> DataFrame:
    """New minus old contributions of the states (records, directed relations)."""
    return difference(contributions(*old[:2]), contributions(*new[:2]))

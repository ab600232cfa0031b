"""The mart: five tables that belong together, built from a state, read from a version folder, or changed by a refresh."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import directed
from ..operators.contributions import PARTS, contributions
from ..operators.rollup import KEY, rebuild_detail, rebuild_report
from ..operators.tables import entity_rows, record_table, relation_rows, with_audit
from ..scratch import settle

TABLES = ("entity", "record", "relation", "report", "report_detail")
#: Keys of the tables whose changes replace rows, and of those whose changes are added up.
REPLACED = {"entity": ("entity_id",), "record": ("data_source", "record_id"), "relation": ("entity_id", "related_id")}
SUMMED = {"report": (("report_key", *KEY), ("entity_count", "record_count", "relation_count")), "report_detail": (("report_key", *KEY, "entity_id", "related_id"), ("stat_count",))}


@dataclass(frozen=True)
class Mart:
    """Five tables. As the change of a mart: replaced rows of the first three (``gone`` marks those that go), additions to the
    counts of the others."""

    entity: DataFrame
    record: DataFrame
    relation: DataFrame
    report: DataFrame
    report_detail: DataFrame

    def state(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(records, directed relations, names) that the mart stands for."""
        records = self.record.where("entity_id <> 0").select("entity_id", "data_source", "record_id", "match_key", "errule_code")
        return records, directed(self.relation), self.entity.select("entity_id", "entity_name")


def rebuild(records: DataFrame, relations: DataFrame, names: DataFrame | None = None, operation: str = "rebuild", parts: Sequence[str] = PARTS) -> Mart:
    """A mart from the records, undirected relations and names (entity_id, entity_name) of a state; with the counts and lists of some
    ``parts`` of the contributions alone, if only these are wanted."""
    both = directed(relations)
    made = contributions(records, both, parts=parts)
    if len(parts) > 1:
        made = settle(made, "contributions")
    entity = with_audit(entity_rows(records, both, names).withColumn("prev_entity_hash", F.lit(None).cast("string")), operation)
    relation = with_audit(relation_rows(relations).withColumn("prev_relation_hash", F.lit(None).cast("string")), operation)
    return Mart(entity, record_table(records, operation), relation, rebuild_report(made), rebuild_detail(made))


def merged(name: str, stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Table ``name`` after ``changes``, which hold each key once. Only rows under the changed keys are joined or added up; the
    others pass by an anti-join."""
    if name in REPLACED:
        keys = list(REPLACED[name])
        return stored.join(changes.select(*keys), keys, "left_anti").unionByName(changes.where("NOT gone").select(*stored.columns))
    keys, counts = SUMMED[name]
    named = changes.select("report_key", *[k for k in keys if k.endswith("_id")])
    both = stored.join(named, named.columns, "left_semi").unionByName(changes).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    if name == "report_detail":
        both = both.where("stat_count <> 0")
    return stored.join(named, named.columns, "left_anti").unionByName(both.select(*stored.columns))


def changed(mart: Mart, change: Mart) -> Mart:
    """The mart after a change."""
    return Mart(**{name: merged(name, getattr(mart, name), getattr(change, name)) for name in TABLES})

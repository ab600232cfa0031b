"""Keyset pages over report_detail: the entities, or the related pairs, behind one count.

A list is named by the plain columns of its report key, so that the filter reaches the scan of a stored report_detail (which is
sorted by them within its buckets). :func:`page_header` tells the counts of a page that may have no rows. The list's keys are computed
once and settled; the page's are chosen from them (TakeOrderedAndProject), and the ids of a page filter the tables that describe it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle

#: Default page size, page size for each sampled row, and the four bound types.
PAGE_SIZE, SAMPLE_FACTOR = 100, 20
#: Records of a chunk of an entity's list; ids of a page that are written into a filter.
CHUNK, MOST_IDS = 1000, 1000
BOUND_TYPES = ("INCLUSIVE_LOWER", "EXCLUSIVE_LOWER", "INCLUSIVE_UPPER", "EXCLUSIVE_UPPER")
MAX_ID = 2**63 - 1


@dataclass(frozen=True)
class Page:
    """Checked arguments of a page."""

    bound: tuple[int, int]
    bound_type: str
    size: int
    sample: int | None
    seed: int = 0

    @property
    def lower(self) -> bool:
        return self.bound_type.endswith("LOWER")

    def holds(self, key: Column, bound: Column) -> Column:
        return {"INCLUSIVE_LOWER": key >= bound, "EXCLUSIVE_LOWER": key > bound, "INCLUSIVE_UPPER": key <= bound, "EXCLUSIVE_UPPER": key < bound}[self.bound_type]


def page(bound: str | int | None = None, bound_type: str | None = None, page_size: int | None = None, sample_size: int | None = None, seed: int = 0, pairs: bool = False) -> Page:
    """Arguments of a page. ``bound``: an id or ``max``; for pairs also ``a:b``, ``a:`` and ``max:max``.

    Without a type, ``max`` (for pairs ``max:max``) means pages before it and anything else pages after it. Missing bounds are 0 or the largest id by
    direction. The page size is 100, or 20 times the sample size.
    """
    text = None if bound is None else str(bound).strip().lower()
    if bound_type is None:
        bound_type = "EXCLUSIVE_UPPER" if text == ("max:max" if pairs else "max") else "EXCLUSIVE_LOWER"
    if bound_type not in BOUND_TYPES:
        raise ValueError(f"unknown bound type: {bound_type}")
    for name, value in (("page size", page_size), ("sample size", sample_size)):
        if value is not None and value < 1:
            raise ValueError(f"the {name} must be positive: {value}")
    size = page_size or (SAMPLE_FACTOR * sample_size if sample_size else PAGE_SIZE)
    if sample_size is not None and sample_size >= size:
        raise ValueError(f"the sample size must be below the page size: {sample_size}, {size}")
    default = 0 if bound_type.endswith("LOWER") else MAX_ID
    one = lambda part: MAX_ID if part == "max" else int(part)
    if not text:
        first = second = default
    elif not pairs:
        first, second = one(text), default
    else:
        head, colon, tail = text.partition(":")
        first = one(head.strip())
        second = one(tail.strip()) if tail.strip() else (MAX_ID if not colon and head == "max" else default)
    return Page((first, second), bound_type, size, sample_size, seed)


class ReportKey(NamedTuple):
    """Report key of a list, in plain parts."""

    report: str
    statistic: str
    source1: str | None = None
    source2: str | None = None

    def of(self, detail: DataFrame) -> DataFrame:
        """Rows of ``detail`` under this key."""
        for name, value in self._asdict().items():
            detail = detail.where(F.col(name).isNull() if value is None else F.col(name) == value)
        return detail


def _page_keys(keys: DataFrame, names: list[str], p: Page) -> DataFrame:
    """The keys of the page, settled."""
    key = F.struct(*names)
    bound = F.struct(*[F.lit(b).cast("long").alias(n) for n, b in zip(names, p.bound)])
    order = [F.col(n).asc() if p.lower else F.col(n).desc() for n in names]
    # A bound on the first id alone goes to the scan too.
    first = F.col(names[0])
    near = first >= F.lit(p.bound[0]) if p.lower else first <= F.lit(p.bound[0])
    return settle(keys.where(near & p.holds(key, bound)).orderBy(*order).limit(p.size), "page")


def page_header(detail: DataFrame, report_key: ReportKey, p: Page | None = None, pairs: bool = False) -> DataFrame:
    """One row about a page, be it empty or not: total, before, after, page_min, page_max, and how many rows are ``shown`` unsampled.
    On an empty page nothing is before it and all is after it."""
    p = p or page(pairs=pairs)
    names = ["entity_id", "related_id"] if pairs else ["entity_id"]
    keys = settle(report_key.of(detail).where("related_id <> 0" if pairs else "related_id = 0").select(*names), "keys")
    key = F.struct(*names)
    ends = _page_keys(keys, names, p).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first()
    low = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, ends.low)]) if ends.n else None
    counts = keys.agg(F.count("*").alias("total"), (F.count_if(key < low) if ends.n else F.lit(0).cast("long")).alias("before"))
    text = lambda end: F.lit(":".join(map(str, end)) if end else None).cast("string")
    return counts.select("total", "before", (F.col("total") - F.col("before") - F.lit(ends.n)).alias("after"), text(ends.low).alias("page_min"), text(ends.high).alias("page_max"), F.lit(ends.n).cast("long").alias("shown"))


def _chosen(keys: DataFrame, names: list[str], p: Page) -> DataFrame:
    """Keys of the page, each with the page's counts: total, before, after, page_min, page_max (of the whole page); settled."""
    keys = settle(keys, "keys")
    key, rows = F.struct(*names), _page_keys(keys, names, p)
    ends = rows.agg(F.min(key).alias("page_min"), F.max(key).alias("page_max"), F.count("*").alias("n"))
    # One row beside one row: the counts of all keys around the page.
    counts = keys.join(F.broadcast(ends), how="inner").groupBy("page_min", "page_max", "n")
    counts = counts.agg(F.count("*").alias("total"), F.count_if(key < F.col("page_min")).alias("before")).withColumn("after", F.col("total") - F.col("n") - F.col("before"))
    if p.sample:
        rows = rows.orderBy(F.md5(F.concat_ws(":", F.lit(p.seed), *names)), *names).limit(p.sample)
    text = lambda c: F.concat_ws(":", *[F.col(f"{c}.{n}") for n in names])
    return settle(rows.join(F.broadcast(counts.drop("n")), how="inner").select(*names, "total", "before", "after", text("page_min").alias("page_min"), text("page_max").alias("page_max")), "chosen")


def _among(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose entity is among ``ids`` (a page at most): by a filter, which reaches what lies below the joins and sums
    that ``table`` is made of; of a larger page by a join."""
    some = [r[0] for r in ids.limit(MOST_IDS + 1).collect()]
    if len(some) > MOST_IDS:
        return table.join(F.broadcast(ids), "entity_id", "left_semi")
    return table.where(F.col("entity_id").isin(some))


_SHOWN = ("data_source", "record_id", "match_key", "errule_code")


def record_chunks(rows: DataFrame, record: DataFrame, size: int = CHUNK, key: str = "entity_id") -> DataFrame:
    """(entity_id, chunk, records): the records of the entities ``key`` of a page, sorted by source and id, ``size`` in each row.

    For pages with entities whose list is too long for one row (pages leave it out by ``lists=False``). The records are
    dealt by range of entity, source and id, so those of a hub entity lie in many tasks; a count for each task and entity
    tells where a task's part of the list begins. An entity without records has no row.
    """
    if size < 1:
        raise ValueError(f"a chunk holds one record at least: {size}")
    order = ["entity_id", "data_source", "record_id"]
    ids = rows.select(F.col(key).alias("entity_id")).distinct()  # a page at most
    dealt = _among(record, ids).select("entity_id", *_SHOWN).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits number the task, the lower ones the row within it.
    dealt = settle(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "chunks")
    parts = dealt.groupBy("entity_id", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # A row for each task that has some of an entity's records.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("entity_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("entity_id", "_task", (before - F.col("_first")).alias("_shift"))
    placed = dealt.join(parts, ["entity_id", "_task"]).withColumn("chunk", F.floor((F.col("_at") + F.col("_shift")) / size))
    return placed.groupBy("entity_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(*_SHOWN))).alias("records"))


def _described(rows: DataFrame, key: str, entity: DataFrame, record: DataFrame | None, prefix: str = "") -> DataFrame:
    """``rows`` with the entity of ``key``: name, counts and its records (where ``record`` is given) sorted by source and id."""
    ids = rows.select(F.col(key).alias("entity_id")).distinct()  # a page at most
    about = _among(entity, ids).select("entity_id", "entity_name", "record_count", "relation_count")
    if record is not None:
        own = _among(record, ids).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*_SHOWN))).alias("records"))
        about = about.join(own, "entity_id", "left")
    about = about.select(F.col("entity_id").alias("_id"), *[F.col(c).alias(prefix + c) for c in about.columns if c != "entity_id"])
    return rows.join(about, F.col(key) == F.col("_id"), "left").drop("_id")


def entities_page(detail: DataFrame, entity: DataFrame, record: DataFrame, report_key: ReportKey, p: Page | None = None, lists: bool = True) -> DataFrame:
    """Entities behind ``report_key``: entity_id, name, counts, records, and the page's counts on each row, ascending.
    ``lists``: False leaves the records to :func:`record_chunks`."""
    p = p or page()
    keys = report_key.of(detail).where("related_id = 0").select("entity_id")
    return _described(_chosen(keys, ["entity_id"], p), "entity_id", entity, record if lists else None).orderBy("entity_id")


def relations_page(detail: DataFrame, entity: DataFrame, record: DataFrame, relation: DataFrame, report_key: ReportKey, p: Page | None = None, lists: bool = True) -> DataFrame:
    """Pairs behind ``report_key``: both entities with their records, match type, rule, and the key as the first entity sees it.
    ``lists``: False leaves the records to :func:`record_chunks`."""
    p = p or page(pairs=True)
    keys = report_key.of(detail).where("related_id <> 0").select("entity_id", "related_id")
    rows = _chosen(keys, ["entity_id", "related_id"], p)
    pair = _among(relation, rows.select(F.least("entity_id", "related_id").alias("entity_id")).distinct()).select(F.col("entity_id").alias("low"), F.col("related_id").alias("high"), "match_type", F.col("match_key").alias("forward"), "rev_match_key", "errule_code")
    rows = F.broadcast(rows).join(pair, (F.least("entity_id", "related_id") == F.col("low")) & (F.greatest("entity_id", "related_id") == F.col("high")), "left")
    key = F.when(F.col("related_id") < F.col("entity_id"), F.col("rev_match_key")).otherwise(F.col("forward"))
    rows = rows.withColumn("match_key", key).drop("low", "high", "forward", "rev_match_key")
    shown = record if lists else None
    rows = settle(_described(rows, "entity_id", entity, shown), "described")
    return _described(rows, "related_id", entity, shown, "related_").orderBy("entity_id", "related_id")

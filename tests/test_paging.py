import pytest
from pyspark.sql import functions as F

from tallymart.operators import paging as G

MAX = 2**63 - 1
KEY = G.ReportKey("ESB", "1")


@pytest.mark.parametrize(
    "args, bound, kind, size",
    [
        ({}, (0, 0), "EXCLUSIVE_LOWER", 100), ({"bound": " MAX "}, (MAX, MAX), "EXCLUSIVE_UPPER", 100), ({"sample_size": 3}, (0, 0), "EXCLUSIVE_LOWER", 60), ({"bound": "7", "bound_type": "INCLUSIVE_UPPER"}, (7, MAX), "INCLUSIVE_UPPER", 100),
        ({"bound": "3:4", "pairs": True}, (3, 4), "EXCLUSIVE_LOWER", 100), ({"bound": "3:", "pairs": True, "bound_type": "EXCLUSIVE_UPPER"}, (3, MAX), "EXCLUSIVE_UPPER", 100), ({"bound": "max", "pairs": True}, (MAX, MAX), "EXCLUSIVE_LOWER", 100),
        ({"bound": "max:max", "pairs": True}, (MAX, MAX), "EXCLUSIVE_UPPER", 100),
    ],
)
def test_bounds(args, bound, kind, size):
    p = G.page(**args)
    assert (p.bound, p.bound_type, p.size) == (bound, kind, size)


@pytest.mark.parametrize("args", [{"page_size": 0}, {"sample_size": 0}, {"page_size": 5, "sample_size": 5}, {"bound": "x"}, {"bound_type": "LOWER"}, {"bound": ":3", "pairs": True}])
def test_wrong_arguments(args):
    with pytest.raises(ValueError):
        G.page(**args)


@pytest.fixture(scope="module")
def tables(spark):
    detail = spark.createDataFrame([("ESB", "1", None, None, i, 0, 1) for i in range(1, 31)], "report string, statistic string, source1 string, source2 string, entity_id long, related_id long, stat_count long")
    entity = spark.range(1, 29).select(F.col("id").alias("entity_id"), F.lit("n").alias("entity_name"), F.lit(1).alias("record_count"), F.lit(0).alias("relation_count"))
    record = spark.range(1, 29).select(F.lit("S").alias("data_source"), F.col("id").cast("string").alias("record_id"), F.col("id").alias("entity_id"), F.lit("k").alias("match_key"), F.lit("r").alias("errule_code"))
    return detail, entity, record


@pytest.mark.parametrize("kind, bound", [(t, b) for t in G.BOUND_TYPES for b in (0, 10, 30, 99)])
def test_pages(tables, kind, bound):
    rows = G.entities_page(*tables, KEY, G.page(bound=bound, bound_type=kind, page_size=7)).collect()
    keep = {"INCLUSIVE_LOWER": lambda i: i >= bound, "EXCLUSIVE_LOWER": lambda i: i > bound, "INCLUSIVE_UPPER": lambda i: i <= bound, "EXCLUSIVE_UPPER": lambda i: i < bound}[kind]
    ids = [i for i in range(1, 31) if keep(i)]
    ids = ids[:7] if "LOWER" in kind else ids[-7:]
    assert [r.entity_id for r in rows] == ids
    for r in rows:
        assert (r.total, r.before, r.after) == (30, ids[0] - 1, 30 - ids[-1]) and (r.page_min, r.page_max) == (str(ids[0]), str(ids[-1]))
        assert (r.entity_name is None) == (r.entity_id > 28)


def test_headers(spark, tables):
    header = lambda key=KEY, **args: tuple(G.page_header(tables[0], key, G.page(**args)).first())
    assert header(bound=99) == (30, 0, 30, None, None, 0) and header(bound=0, bound_type="EXCLUSIVE_UPPER") == (30, 0, 30, None, None, 0)
    assert header(bound=10, page_size=7) == (30, 10, 13, "11", "17", 7)
    assert header(G.ReportKey("ESB", "9")) == (0, 0, 0, None, None, 0)
    pairs = spark.createDataFrame([("DSS", "P", "A", "A", i // 3, i % 3 + 1, 1) for i in range(12)], tables[0].schema)
    of = lambda **args: tuple(G.page_header(pairs, G.ReportKey("DSS", "P", "A", "A"), G.page(pairs=True, **args), pairs=True).first())
    assert of(bound="1:2", page_size=4) == (12, 5, 3, "1:3", "2:3", 4) and of(bound="max:max", bound_type="INCLUSIVE_LOWER") == (12, 0, 12, None, None, 0)


def test_samples(tables):
    shown = G.entities_page(*tables, KEY, G.page(bound=5, page_size=20, sample_size=4, seed=1)).collect()
    again = G.entities_page(*tables, KEY, G.page(bound=5, page_size=20, sample_size=4, seed=1)).collect()
    assert shown == again and len(shown) == 4 and all(5 < r.entity_id <= 25 and (r.page_min, r.page_max) == ("6", "25") for r in shown)


def test_chunks_of_a_hub_make_up_its_list(spark, tables):
    """Half of all records belong to one entity: its chunks are bounded and in order, and no record is lost."""
    detail, entity, _ = tables
    record = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 20 + 4).cast("long").alias("entity_id"), F.when(F.col("id") % 3 == 0, "S").otherwise("T").alias("data_source"),
        F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 5 == 0, "k").alias("match_key"), F.lit(None).cast("string").alias("errule_code"), F.lit(1).alias("chunk"))
    p = G.page(bound=2, page_size=9)
    rows = G.entities_page(detail, entity, record, KEY, p, lists=False)
    assert "records" not in rows.columns
    parts = {}
    for r in G.record_chunks(rows, record, 70).orderBy("entity_id", "chunk").collect():
        assert r.chunk == len(parts.setdefault(r.entity_id, [])) and len(r.records) <= 70
        parts[r.entity_id].append(r.records)
    whole = {r.entity_id: r.records for r in G.entities_page(detail, entity, record, KEY, p).collect() if r.records}
    assert {i: [x for part in lists for x in part] for i, lists in parts.items()} == whole
    assert len(parts[3]) == 29 and all(len(part) == 70 for part in parts[3][:-1])
    assert G.record_chunks(rows.limit(0), record).isEmpty()
    with pytest.raises(ValueError):
        G.record_chunks(rows, record, 0)

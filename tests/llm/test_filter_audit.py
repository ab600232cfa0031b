"""The filter audit against plain code over all orders, file by file."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tallymart.llm import filter_audit
from tallymart.llm.oracles import ORACLES
from tallymart.llm.queries import op13_filter_audit
from tallymart.llm.scratch import shared_path

DOCS = "doc_id long, text string, source string, id string, part int, mask string, n string"
LABELS = "doc_id long, quality int, toxic int, id string"


def brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marks = {k: {i for i, q, t in labels if i is not None and (q, t)[at] == 1} for at, k in enumerate(("good", "toxic"))}
    out = Counter()
    for i, text, source in docs:
        t, part = text or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        failed = {f for f in fails if fails[f]}
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                earlier = failed & set(order[: step - 1])
                row = (part, order, step)
                out[(*row, "n")] += 1
                out[(*row, "kept")] += not earlier and f not in failed
                out[(*row, "removed")] += not earlier and f in failed
                out[(*row, "redundant")] += bool(earlier) and f in failed
                out[(*row, "unique_fails")] += failed == {f}
                out[(*row, "good_lost")] += not earlier and f in failed and i in marks["good"]
                out[(*row, "toxic_lost")] += not earlier and f in failed and i in marks["toxic"]
                out[(part, f, "shapley")] += not earlier and f in failed
    return out


def check(rows, true):
    assert len(rows) == 600 * len({r.part for r in rows}) == sum(1 for k in true if k[-1] == "n")
    for r in rows:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == true[(r.part, r.filter_order, r.step, c)], (r, c)
        assert r.shapley == true[(r.part, r.filter_order[r.step - 1], "shapley")]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 60, 45, 300)] + ["LOUD " * 60, "a#b " + " ".join(words[:80]), "", None, "x", "éà  Z " * 30, " ".join(words) * 200]
    docs = [(rng.randint(0, 60), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(150)]
    docs += [(None, texts[0], "a"), (None, texts[0], "a"), (None, "alone", None), (7, texts[1], "a"), (7, texts[1], "b"), (7, texts[1], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 70, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed,files", [(1, 7), (2, 1), (3, 12)])
def test_all_orders_after_all_batches(spark, seed, files):
    docs, labels = corpus(seed)
    docs.sort(key=lambda d: -(d[0] if d[0] is not None else 999))  # smaller ids come later: their elders are retracted
    path = shared_path(spark, "test-audit")
    for at in range(files):
        spark.createDataFrame([(*d, "clash", 1, "clash", "clash") for d in docs[at::files] if files < 9] or [(*d, "clash", 1, "clash", "clash") for d in docs[at * len(docs) // files : (at + 1) * len(docs) // files]], DOCS).coalesce(1).write.mode("append").parquet(path)
    cells = filter_audit.cells_of_files(spark, path, spark.createDataFrame([(*l, "clash") for l in labels], LABELS), batches=6)
    assert min(r.n for r in cells.collect()) > 0
    check(filter_audit.report(cells).collect(), brute(docs, labels))


def test_retracted_when_a_smaller_id_arrives(spark):
    """Three files, one row each, ids falling: the last one alone does not fail E."""
    path = shared_path(spark, "test-audit")
    for i, part in ((9, "x"), (5, "y"), (1, "z")):
        spark.createDataFrame([(i, "same", part)], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(path)
    cells = filter_audit.cells_of_files(spark, path, spark.createDataFrame([(5, 1, 1, "")], LABELS), batches=3).collect()
    assert sorted((r.part, bool(r.mask & filter_audit.REPEATED), r.good, r.toxic, r.n) for r in cells) == [("x", True, 0, 0, 1), ("y", True, 1, 1, 1), ("z", False, 0, 0, 1)]


def test_labels_stay_out_of_the_driver(spark):
    """The copies of the labels are never broadcast, however small their file is."""
    docs = spark.createDataFrame([(1, "t", "s"), (2, "u", None)], "doc_id long, text string, source string")
    flags = filter_audit.settle(filter_audit.label_flags(spark.createDataFrame([(1, 1, 0, "")], LABELS)), "test-flags")
    joined = filter_audit._labelled(filter_audit.features(docs, 4), flags)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.good, r.toxic) for r in joined.collect()) == [(1, 1, 0), (2, 0, 0)]


def test_empty(spark):
    path = shared_path(spark, "test-audit")
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(path)
    assert filter_audit.report(filter_audit.cells_of_files(spark, path, spark.createDataFrame([], LABELS))).count() == 0


def test_query_against_sql(spark, sf_dir):
    ours = op13_filter_audit(spark, sf_dir)
    columns = sorted(ours.columns)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    true = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op13_filter_audit']})").fetchall()
    assert len(true) % 600 == 0 and sorted(map(tuple, ours.select(*columns).collect())) == sorted(true)

"""Ball k-means against measuring every entry in plain numbers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import ball_codes
from tallymart.llm.oracles import ORACLES
from tallymart.llm.queries import op11_ball_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, code string, error string"


def brute(rows, parts, entries, rounds, scale=256):
    """[(vec_id, label, code, error)] and the codebooks."""
    kept = [(i, label, [math.floor(scale * float(np.float32(c))) for c in x]) for i, x, label in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    width = len(kept[0][2]) // parts
    cut = lambda x, p: tuple(x[p * width : (p + 1) * width])
    start = sorted((i, x) for i, _, x in kept if i is not None)[:entries]
    books = [[cut(x, p) for _, x in start] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    nearest = lambda a, book: min((far(a, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [(cut(x, p), nearest(cut(x, p), books[p])[1]) for _, _, x in kept]
            for e in range(len(books[p])):
                own = [a for a, to in mine if to == e]
                if own:
                    books[p][e] = tuple(sum(a[k] for a in own) // len(own) for k in range(width))
    out = []
    for i, label, x in kept:
        best = [nearest(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books


def vectors(seed, n, length=8):
    rng = random.Random(seed)
    # Few distinct values: many ties, equal entries and repeated vectors.
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3]) for _ in range(length)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(3, rows[3][1], 1), (3, [0.125] * length, 1), (None, [0.3] * length, None), (900, None, 0), (901, [], 0), (902, [None] * length, 0), (903, [float("nan")] * length, 0), (904, [float("inf")] + [0.0] * (length - 1), 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,entries", [(1, 60, 5), (2, 40, 64), (3, 90, 7)])
def test_codes_are_those_of_measuring_everything(spark, seed, n, entries):
    rows = vectors(seed, n)
    table = spark.createDataFrame([(i, x, label, "clash", 1, "clash", "clash") for i, x, label in rows], SCHEMA)
    coded, books = ball_codes.encode(table, parts=4, entries=entries, rounds=3)
    true, codebooks = brute(rows, 4, entries, 3)
    found = [(r.id, r.label, bytes(r.code).hex(), r.error) for r in coded.collect()]
    assert sorted(found, key=repr) == sorted(true, key=repr)
    assert books.values.tolist() == [[list(c) for c in book] for book in codebooks]
    assert books.digest() == hashlib.sha256(",".join(str(v) for book in codebooks for c in book for v in c).encode()).hexdigest()
    sums = {label: sum(e for _, other, _, e in true if other == label) for label in (0, 1, None)}
    errors = ball_codes.with_label_errors(coded).select("label", "label_error").collect()
    assert len(errors) == len(true) and all(r.label_error == sums[r.label] for r in errors)


def test_rings_and_cores_spare_measurements():
    rng = np.random.default_rng(4)
    centres = rng.integers(-5000, 5000, (4, 32, 4))
    x = (centres[:, rng.integers(0, 32, 4000)] + rng.integers(-40, 40, (4, 4000, 4))).transpose(1, 0, 2).copy()
    books = ball_codes.Codebooks(centres)
    entry, far = ball_codes.assign_all(x, books)
    for before in (entry, np.zeros_like(entry), (entry + 1) % 32):
        again, best, measured = ball_codes.assign_from(x, before, books)
        assert (again == entry).all() and (best == far).all()
    assert ball_codes.assign_from(x, entry, books)[2] < entry.size * 3  # of 32 each


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    coded, books = ball_codes.encode(empty)
    assert books is None and ball_codes.with_label_errors(coded).count() == 0
    no_ids = spark.createDataFrame([(None, [0.5] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert ball_codes.encode(no_ids)[1] is None
    mixed = spark.createDataFrame([(1, [0.5] * 16, 1), (0, [0.25] * 32, 1)], "vec_id long, embedding array<float>, label int")
    assert [r.id for r in ball_codes.encode(mixed)[0].collect()] == [0]
    with pytest.raises(ValueError):
        ball_codes.encode(spark.createDataFrame([(1, [0.5] * 15, 1)], "vec_id long, embedding array<float>, label int"))


def test_query_against_sql(spark, sf_dir):
    ours = op11_ball_codes(spark, sf_dir)
    columns = sorted(ours.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    true = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op11_ball_codes']})").fetchall()
    assert len(true) > 100 and sorted(map(tuple, ours.select(*columns).collect())) == sorted(true)
    assert ours.agg(F.countDistinct("code")).first()[0] > 50

import hashlib
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from test_others import brute_kneser_ney, brute_targets
from test_simhash import brute_similar
from tokenizers import Tokenizer

import corpus_pipeline
from tallymart.llm import bpe, mixing, oracles, quality, queries, secret_scan
from tallymart.llm.queries import TOKENIZER, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == COLUMNS, name
    kept = docs.collect()
    assert kept and all(r.doc_id in before for r in kept) and max(np.unique([r.doc_id for r in kept], return_counts=True)[1]) <= 2
    assert not any("token = \"" in r.text for r in kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    codec = bpe.load(TOKENIZER)
    assert sorted((r.doc_id, bytes(r.ids)) for r in last) == sorted((r.doc_id, codec.encode(r.text)) for r in kept)
    assert all(r.round_trip for r in last)


def brute_good(docs, labels):
    """Documents that the quality stage keeps, scored with dictionaries of strings."""
    text = {d: r.text or "" for d, r in docs.items()}
    good = [d for d in docs if d in labels and labels[d].quality == 1 and not labels[d].toxic]
    fold = {d: xxhash.xxh64_intdigest(t.encode(), 42) & 1 for d, t in text.items()}
    models, memo = [brute_kneser_ney([text[d] for d in good if fold[d] == f]) for f in (0, 1)], {}

    def score(d):
        f, counts = 1 - fold[d], {}
        grams, p = models[f]
        for g in grams(text[d]):
            if (f, g) not in memo:
                memo[f, g] = -math.log(p(g))
            counts[g] = counts.get(g, 0) + 1
        total = sum(counts.values())
        even = (math.log(total) - sum(n * math.log(n) for n in counts.values()) / total) / math.log(total + 1) if total else 0.0
        return sum(n * memo[f, g] for g, n in counts.items()), total, even

    scores = {d: score(d) for d in docs}

    def means(some):
        n = sum(scores[d][1] for d in some)
        return sum(scores[d][0] for d in some) / n, sum(scores[d][1] * scores[d][2] for d in some) / n

    def limits(some):
        highest = sorted(drawn[d][0] for d in some)[math.ceil(quality.QUANTILE * len(some)) - 1]
        return highest, sorted(drawn[d][1] for d in some)[math.floor((1 - quality.QUANTILE) * len(some) + 1e-9)]

    of = {lang: [d for d in good if docs[d].lang == lang] for lang in {r.lang for r in docs.values()}}
    mean, drawn = {lang: means(some or good) for lang, some in of.items()}, {}
    for d, (bits, n, even) in scores.items():
        m = mean[docs[d].lang]
        drawn[d] = tuple(math.floor((x + quality.PRIOR * y) / (n + quality.PRIOR) / quality.STEP) for x, y in ((bits, m[0]), (even * n, m[1])))
    limit = {lang: limits(some or good) for lang, some in of.items()}
    return [d for d in docs if drawn[d][0] <= limit[docs[d].lang][0] and drawn[d][1] >= limit[docs[d].lang][1]]


def brute_redacted(text):
    spans = []
    for rule in secret_scan.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text, re.A) if len(m[rule.group]) >= rule.least]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def brute_copies(docs):
    """Copies of each of ``docs`` (doc_id: (source, size)): a prefix of the seeded order gets one more."""
    sizes = {}
    for source, size in docs.values():
        sizes[source] = sizes.get(source, 0) + size
    target, copies = brute_targets(sizes), {}
    for source, total in sizes.items():
        whole = math.floor(target[source] / total) if total else 0
        goal, at = target[source] - whole * total, 0
        for _, size, d in sorted((hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest(), n, d) for d, (s, n) in docs.items() if s == source):
            copies[d] = min(2, whole + (total > 0 and at + size / 2 <= goal))
            at += size
    return copies


def test_rows_against_brute_force(spark, sf_dir, tmp_path):
    """All documents of sf0.001 with secrets planted in every seventh, and a null, an empty and two short texts of no known language."""
    planted = table(spark, sf_dir, "documents").toPandas()
    hit = planted.doc_id % 7 == 3
    planted.loc[hit, "text"] += " password: hunter2hunter2, key AKIA" + "ABCDEFGH12345678" + " and token=\"0123456789abcdef01234567\"."
    last = int(planted.doc_id.max())
    odd = [(last + 1, None, "en", None, None), (last + 2, "", "en", "a", 0), (last + 3, "secret: abcdefgh", None, None, 16), (last + 4, "x", "xx", "a", 1)]
    more = spark.createDataFrame(odd, table(spark, sf_dir, "documents").select(*COLUMNS).schema).toPandas()
    pd.concat([planted[COLUMNS], more]).astype({"n_chars": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet", index=False)
    table(spark, sf_dir, "labels").toPandas().to_parquet(f"{tmp_path}/labels.parquet", index=False)
    sf_dir = str(tmp_path)
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    good = brute_good(docs, labels)
    groups, _ = brute_similar({d: docs[d].text for d in good})
    text = {d: brute_redacted(docs[d].text or "") for d in set(groups.values())}
    copies = brute_copies({d: (docs[d].source, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t in text.items()})
    assert len(docs) > len(good) > len(text) and any("[SECRET]" in t for t in text.values()) and {0, 1, 2} <= set(copies.values())
    library = Tokenizer.from_file(TOKENIZER)
    true = []
    for d, n in copies.items():
        ids = library.encode(text[d], add_special_tokens=False).ids
        true += [(d, docs[d].source, docs[d].lang, len(ids), np.array(ids, dtype="<u4").tobytes(), True)] * n
    found = [(r.doc_id, r.source, r.lang, r.n_tokens, bytes(r.ids), r.round_trip) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(found, key=repr) == sorted(true, key=repr)


def test_empty_and_odd_documents(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "x", "en", "a", 1), (3, "x", "en", "a", 1)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixing", "encoding"]


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ours = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(ours.columns)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    true = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(rounded, ours.select(*columns).collect()))) == sorted(map(repr, map(rounded, true)))

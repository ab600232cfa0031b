import random

import numpy as np
import pytest
import xxhash

from tallymart import scratch
from tallymart.llm import near_copies, simhash
from tallymart.llm.components import components
from tallymart.llm.queries import op1_simhash, table

SCHEMA = "doc_id long, text string, fp string, key string"


def brute_fingerprint(text, shingle=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(links, names):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def brute(rows):
    fps = {d: brute_fingerprint(t) for d, t in rows}
    ids = sorted(fps)
    return fps, brute_groups([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    fps, groups = brute(rows)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf_dir).collect()}
    assert found == {d: (f"{fps[d]:016x}", groups[d]) for d in fps}


@pytest.mark.parametrize("seed", range(2))
def test_tree_finds_every_close_pair(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)} | {0, 2**64 - 1, 7}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    links = simhash.tree_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 3, leaf_rows=8)
    found = brute_groups([(r.a, r.b) for r in links.collect()], [signed(f) for f in fps])
    true = brute_groups([(signed(a), signed(b)) for a in fps for b in fps if (a ^ b).bit_count() <= 3], [signed(f) for f in fps])
    partition = lambda groups: sorted(sorted(k for k in groups if groups[k] == r) for r in set(groups.values()))
    assert partition(found) == partition(true)


def test_edge_cases(spark):
    rows = [(5, None, "x", "y"), (3, "", "x", "y"), (9, " \t\n", "x", "y"), (2, "One two", "x", "y"), (1, "one\x0btwo", "x", "y"), (2, "One two", "x", "y"), (None, "alone", "x", "y"), (7, "w " * 3000, "x", "y")]
    out = simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id is not None) == [(1, 1), (2, 1), (2, 1), (3, 3), (5, 3), (7, 7), (9, 3)]
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(80)] + [(100, 100), (200, 201), (201, 200), (200, 201)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(81)}) == 1 and roots[200] == roots[201] != roots[0] and 100 not in roots


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_trees_prune_and_lose_no_pair():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    near = fps[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    every = np.concatenate([fps, near])
    tree = simhash.grow(every[::3], len(every), leaf_rows=20)
    assert (tree.branch[:, 0] >= 0).sum() > 50 and len(set(tree.vantage.tolist())) > 50
    row, leaf, cost = simhash.route(tree, every, 2)
    stored = {(r, n) for r, n, c in zip(row.tolist(), leaf.tolist(), cost.tolist()) if c <= 1}
    asked = set(zip(row.tolist(), leaf.tolist()))
    leaves = {}
    for r, n in asked:
        leaves.setdefault(r, set()).add(n)
    for i in range(2000):
        assert any((i, n) in stored for n in leaves[6000 + i]) and any((6000 + i, n) in stored for n in leaves[i])
    held = np.bincount([n for _, n in stored])
    assert held.max() < 2000 and (held.astype(float) ** 2).sum() < 0.2 * len(every) ** 2


def test_hot_leaves_are_dealt_to_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    rng = random.Random(3)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(150)})
    links = simhash.tree_links(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long"), 3, leaf_rows=1000)
    groups = brute_groups([(r.a % 2**64, r.b % 2**64) for r in links.collect()], fps)
    true = brute_groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    assert len(set(groups.values())) == len(set(true.values())) and all((groups[a] == groups[b]) == (true[a] == true[b]) for a in fps for b in fps[:20])


def brute_similar(texts, similarity=0.8, shingle=5):
    """Groups by exact similarity of all pairs, found without any of the module's code."""
    sets = {}
    for d, t in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    holders, close, ids = {}, [], sorted(sets)
    for d in ids:
        for g in sets[d]:
            holders.setdefault(g, []).append(d)
    shared = {}
    for some in holders.values():
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    close = [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    empty = [d for d in ids if not sets[d]]
    return brute_groups(close + [(empty[0], e) for e in empty[1:]], ids), close


def test_near_copies_against_brute_force(spark):
    """All documents of sf0.01: what stays is the smallest id of each exact group; recall of the groups, and no false ones."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    groups, close = brute_similar({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in near_copies.near_copies(docs).collect()}
    gone, true = set(groups) - kept, set(groups) - set(groups.values())
    assert len(close) > 50 and not gone - true
    assert len(gone) >= 0.98 * len(true)


def test_links_are_verified_pairs(spark):
    """Chains of edits: each text is a near copy of the next one only; texts below the similarity stay."""
    rng = random.Random(11)
    text, chain = words(rng, 200), []
    for i in range(12):
        chain.append((i, " ".join(text)))
        text = text[12:] + words(rng, 12)
    loose = words(rng, 200)
    apart = [(100, " ".join(loose)), (101, " ".join(loose[:150] + words(rng, 50)))]
    twice = " ".join(words(rng, 60))
    rows = spark.createDataFrame(chain + apart + [(200, twice), (201, f"{twice} {twice}"), (300, "one two three"), (301, "one two three four")], "doc_id long, text string")
    groups, _ = brute_similar({r.doc_id: r.text for r in rows.collect()})
    assert {r.doc_id for r in near_copies.near_copies(rows).collect()} == set(groups.values()) >= {0, 100, 101, 200, 300, 301}


def test_strays_in_large_buckets(spark, monkeypatch):
    """One bucket of many copies, and others that do not belong to its least node."""
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", 8)
    monkeypatch.setattr(near_copies, "NEAREST", 1)
    rng = random.Random(2)
    base, other, texts = words(rng, 120), words(rng, 120), {}
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        texts[i] = " ".join(copy)
        mixed = base[:60] + other[:60]
        mixed[rng.randrange(60)] = f"y{i}"
        texts[100 + i] = " ".join(mixed)
    groups, _ = brute_similar(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.near_copies(rows).collect()} == set(groups.values())


def test_near_copies_go_and_others_stay(spark):
    rng, rows, alone = random.Random(5), [], []
    for i in range(30):
        base = words(rng, rng.randint(150, 400))
        rows.append((10 * i, " ".join(base), "s", "k"))
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        rows += [(10 * i + 1, " ".join(copy), "s", "k"), (10 * i + 2, " ".join(base).upper(), "s", "k")]
        alone.append(10 * i + 5)
        rows.append((10 * i + 5, " ".join(words(rng, 200)), "s", "k"))
    rows += [rows[0], (None, None, None, None), (7777, "", None, None), (8888, "two words", None, None)]
    kept = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "key"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([10 * i for i in range(30)] + alone + [7777, 8888])


def test_near_copies_with_odd_columns(spark):
    rows = [(1, "a b c d e f", {"k": 1}, "x"), (1, "a b c d e f", {"k": 1}, "x"), (2, "A b c d  e f", {"k": 2}, "y"), (None, "a b c d e f", None, "z"), (None, "alone here", None, "z"), (None, "alone here", None, "z"), (7, None, None, None), (8, " ", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc map<string, int>, _kept_id string").selectExpr("*", "doc_id AS idh", "doc_id AS content", "doc_id AS key", "doc_id AS _made", "doc_id AS rep", "doc_id AS root")
    out = near_copies.near_copies(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "alone here"), (1, "a b c d e f"), (7, "")]
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_forest_holds_pairs_of_the_similarity():
    """Pairs whose bits differ as often as the similarity implies meet in a leaf, pairs of strangers in few."""
    rng = np.random.default_rng(3)
    all_bits = rng.integers(0, 2, (40_000, near_copies.BITS)).astype(np.uint8)
    trees = near_copies.forest(all_bits[:20_000], 40_000, 0.8)
    some = all_bits[20_000:24_000]
    met = lambda other: [near_copies._leaves(t, near_copies._words(some[:, p])) == near_copies._leaves(t, near_copies._words(other[:, p])) for p, t in trees]
    moved = some ^ (rng.random(some.shape) < near_copies.turned(0.8))
    assert len(trees) > 5 and np.any(met(moved), axis=0).mean() >= 0.99
    assert np.mean(met(all_bits[24_000:28_000])) < 0.1


def test_near_copies_in_many_leaves(spark, monkeypatch):
    """All documents of sf0.01 in leaves of few: candidates come through the vantage-point trees alone, and links go on for several turns."""
    monkeypatch.setattr(near_copies, "LEAF_ROWS", 32)
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", 16)
    grown = []
    monkeypatch.setattr(near_copies, "grow", lambda *a: grown.append(simhash.grow(*a)) or grown[-1])
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    groups, _ = brute_similar({r.doc_id: r.text for r in docs.collect()})
    gone, true = set(groups) - {r.doc_id for r in near_copies.near_copies(docs).collect()}, set(groups) - set(groups.values())
    assert len(grown) > 5 and min((t.branch[:, 0] < 0).sum() for t in grown) >= 16
    assert not gone - true and len(gone) >= 0.98 * len(true)


def test_near_copies_leave_one_table(spark, tmp_path, monkeypatch):
    """Only what the result is read from stays in the shared folder."""
    shared = scratch.shared_path
    monkeypatch.setattr(scratch, "shared_path", lambda spark, name: f"file://{tmp_path}/{shared(spark, name).rsplit('/', 1)[1]}")
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    out = near_copies.near_copies(rows)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["copies-kept"]
    assert [r.doc_id for r in out.collect()] == [1]

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import ball_codes, filter_audit, licenses, mixing, secret_scan

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS owner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM d
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op3() -> str:
    rows = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    base = ", ".join(f"({_quoted(phrase)}, {_quoted(label)})" for phrase, label in licenses.BASE)
    words = f"regexp_extract_all({LOWER.format('text')}, {_quoted(licenses.WORD)})"
    # Of a window of diagonals, the best chain of rising votes, place by place of the template.
    tail = "greatest(3 + coalesce(list_max(b[1 : greatest(p[1] - 2, 0)]), 0), CASE WHEN p[1] >= 1 AND b[p[1]] > 0 THEN 1 + b[p[1]] ELSE 0 END, CASE WHEN p[1] >= 2 AND b[p[1] - 1] > 0 THEN 2 + b[p[1] - 1] ELSE 0 END)"
    chain = f"list_max(list_reduce(votes, lambda b, p: b[1 : p[1]] || [greatest(b[p[1] + 1], {tail})] || b[p[1] + 2 :], list_transform(range(0, n), lambda i: 0)))"
    return f"""
WITH tpl AS (SELECT t AS template, label, regexp_extract_all({LOWER.format('text')}, {_quoted(licenses.WORD)}) AS w FROM (VALUES {rows}) v(t, label, text)),
tg AS (SELECT template, label, len(w) AS n, {licenses.DRIFT} + CAST(floor(len(w) * CAST({1 - licenses.COVER!r} AS DOUBLE)) AS INT) AS drift, i AS place, w[i+1] AS a, w[i+2] AS b, w[i+3] AS c
  FROM (SELECT *, unnest(range(0, len(w) - 2)) AS i FROM tpl)),
docs AS (SELECT doc_id, {words.replace('text', "coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT doc_id, i AS pos, w[i+1] AS a, w[i+2] AS b, w[i+3] AS c FROM (SELECT *, unnest(range(0, greatest(0, len(w) - 2))) AS i FROM docs)),
votes AS (SELECT DISTINCT doc_id, template, label, n, drift, pos, place FROM dg JOIN tg USING (a, b, c)),
starts AS (SELECT DISTINCT doc_id, template, pos - place AS start FROM votes),
windows AS (SELECT doc_id, label, n, list([CAST(place AS INT)] ORDER BY pos, place DESC) AS votes FROM votes JOIN starts USING (doc_id, template)
  WHERE pos - place BETWEEN start AND start + drift GROUP BY doc_id, template, label, n, start HAVING count(DISTINCT place) * 3 >= {licenses.COVER} * n),
covers AS (SELECT doc_id, label, {chain} / CAST(n AS DOUBLE) AS cover FROM windows),
best AS (SELECT doc_id, max(cover) AS cover, list(DISTINCT label) AS labels FROM covers WHERE cover >= {licenses.COVER} GROUP BY doc_id),
bp AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {base}) v(phrase, label)),
hits AS (SELECT doc_id, label, i AS pos FROM (SELECT doc_id, w, p, label, unnest(range(0, len(w))) AS i FROM docs, bp WHERE list_has_all(w, p)) WHERE w[i+1 : i+len(p)] = p),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, best.labels))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op6() -> str:
    word = _quoted(mixing.WORD)
    return f"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {word})), 0) AS BIGINT) AS size,
  md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
e AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s GROUP BY source),
f AS (SELECT *, {list(mixing.WEIGHTS)}[turn % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {mixing.MAX_EPOCHS} AS cap FROM e),
g AS (SELECT *, sum(source_size) OVER () * CAST({mixing.SHARE} AS DOUBLE) AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM f),
c AS (SELECT *, cap * onward <= weight * (total - before) AS capped FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
  weight * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
ties AS (SELECT source, h, size, sum(size) AS words FROM s GROUP BY ALL),
o AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h, size) - words AS start FROM ties),
x AS (SELECT o.source, h, size, start + words / 2 <= target - whole * source_size AND target > whole * source_size AS extra FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source)
SELECT s.doc_id, s.size, r.source_size, r.target, CAST(s.size * (r.whole + CAST(x.extra AS INT)) AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source JOIN x ON s.source IS NOT DISTINCT FROM x.source AND s.h = x.h AND s.size = x.size
"""


def op7() -> str:
    def found(no: int, rule: secret_scan.Rule) -> str:
        p = _quoted(rule.pattern)
        part = f"regexp_extract(m[i], {p}, {rule.group})"
        end = "list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x)))"
        return f"""SELECT doc_id, {no} AS no, '{rule.kind}' AS kind, CAST(e - length(m[i]) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
  SELECT *, {end} AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM docs))) WHERE length({part}) >= {rule.least}"""

    kinds = [r.kind for r in secret_scan.BASE]
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in kinds)
    is_base = f"kind IN ({', '.join(map(_quoted, kinds))})"
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no){0}, '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(found(no, rule) for no, rule in enumerate(secret_scan.RULES))})
SELECT docs.doc_id, {counts}, sha256({joined.format(f' FILTER ({is_base})')}) AS base_sha256, {joined.format('')} AS spans
FROM docs LEFT JOIN found USING (doc_id) GROUP BY docs.doc_id
"""


OP8 = """
WITH v AS (SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid AS q, q.vec_id AS query_id, c.vec_id, c.uid, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, uid) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op11() -> str:
    """Every part measured against every entry, round by round."""
    places = range(1, 64 // ball_codes.PARTS + 1)
    far = " + ".join(f"(x.v[{i}] - c.v[{i}]) * (x.v[{i}] - c.v[{i}])" for i in places)
    mean = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in places)

    def nearest(n: int) -> str:
        return f"a{n} AS (SELECT uid, part, x.v, min(struct_pack(far := {far}, entry := c.entry)) AS best FROM parts x JOIN c{n} c USING (part) GROUP BY uid, part, x.v)"

    def moved(n: int) -> str:
        return f"""m{n} AS (SELECT part, best.entry AS entry, [{mean}] AS v FROM a{n} GROUP BY part, best.entry),
c{n + 1} AS (SELECT part, entry, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (part, entry))"""

    steps = ",\n".join(f"{nearest(n)},\n{moved(n)}" for n in range(ball_codes.ROUNDS))
    width = len(places)
    return f"""
WITH kept AS (SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({ball_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT uid, vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS v FROM (SELECT *, unnest(range(0, {ball_codes.PARTS})) AS part FROM kept)),
first AS (SELECT uid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept WHERE vec_id IS NOT NULL QUALIFY entry < {ball_codes.ENTRIES}),
c0 AS (SELECT part, entry, v FROM parts JOIN first USING (uid)),
{steps},
{nearest(ball_codes.ROUNDS)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM c{ball_codes.ROUNDS}),
codes AS (SELECT uid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{ball_codes.ROUNDS} GROUP BY uid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM codes JOIN kept USING (uid), books
"""



def op13() -> str:
    """All 120 orders over the documents' masks; ``first`` is the smallest id of a text."""
    odd, word = _quoted(filter_audit.ODD), _quoted(r"[^\x20\x09-\x0D]+")
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < {filter_audit.LEAST_WORDS}, 100 * len(list_distinct(w)) < {filter_audit.DISTINCT_PERCENT} * len(w),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.CAPITAL_PERCENT} * length(t), regexp_matches(t, {odd}), coalesce(doc_id > first, false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, 15 - a.i - b.i - c.i - d.i AS e FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i)
  WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND b.i <> c.i AND b.i <> d.i AND c.i <> d.i),
s AS (SELECT [a, b, c, d, e] AS p, unnest(range(1, 6)) AS step FROM o),
j AS (SELECT part, p, step, p[step] AS filter, fails, n, good, toxic, fails[p[step]] AS own, list_bool_or(list_transform([0] || p[1 : step - 1], lambda i: i > 0 AND fails[greatest(i, 1)])) AS earlier FROM g, s),
r AS (SELECT part, p, step, filter, sum(CASE WHEN own OR earlier THEN 0 ELSE n END) AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN own AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, array_to_string(list_transform(p, lambda i: substr('{filter_audit.FILTERS}', CAST(i AS INT), 1)), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""


ORACLES: dict[str, str] = {"op2_warc": OP2, "op3_licenses": op3(), "op6_mixing": op6(), "op7_secrets": op7(), "op8_topk": OP8, "op11_ball_codes": op11(), "op13_filter_audit": op13()}

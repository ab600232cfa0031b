"""DuckDB twins of the registered mart queries, over the same base tables."""

from __future__ import annotations

from .functions.keys import COMPONENT, MATCH_TYPES
from .plans.reports import KINDS
from .queries import BASE, ONE, TWO
from .sources.fixtures import common_tables

STAT = "{base} || CASE WHEN k IS NOT NULL THEN ':' || coalesce(p, '') || ':' || k WHEN p IS NOT NULL THEN ':' || p ELSE '' END"
SWAP = r"(?s)^((?:\\.|[^\\(])*(?:\\\S|[^\\(\s]))\(((?:\\.|[^\\:)])*):((?:\\.|[^\\:)])*)\)(.*)$"


def _enc(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


KEY = f"report || ':' || {_enc('statistic')} || CASE WHEN source1 IS NULL THEN '' ELSE ':' || {_enc('source1')} || coalesce(':' || {_enc('source2')}, '') END"


def _state(rec: str, rel: str, s: str, names: str = "fx_names") -> str:
    """Everything that follows from one state; ``s`` ends the names."""
    row = "'{0}' AS report, {1} AS statistic, {2} AS source1, {3} AS source2, entity_id, {4} AS related_id, {5} AS entities, {6} AS records, {7} AS relations"
    code = "CASE WHEN source1 = source2 THEN 'DSS' ELSE 'CSS' END"
    related = f"{code} AS report, {STAT.format(base='match_type || ' + chr(39) + '_COUNT' + chr(39))} AS statistic, source1, source2, entity_id"
    matched = STAT.format(base="'MATCHED_COUNT'")
    return f"""
dir{s} AS (SELECT entity_id, related_id, match_type, match_key, rev_match_key, errule_code FROM {rel}
  UNION ALL SELECT related_id, entity_id, match_type, rev_match_key, match_key, errule_code FROM {rel}),
src{s} AS (SELECT entity_id, data_source, count(*) AS records FROM {rec} GROUP BY ALL),
links{s} AS (SELECT entity_id, count(*) AS n FROM dir{s} GROUP BY ALL),
cnt{s} AS (SELECT entity_id, record_count, coalesce(n, 0) AS relation_count FROM (SELECT entity_id, count(*) AS record_count FROM {rec} GROUP BY ALL) LEFT JOIN links{s} USING (entity_id)),
mv{s} AS (SELECT DISTINCT entity_id, k, p FROM {rec}, LATERAL (SELECT unnest([NULL, match_key]) AS k) a, LATERAL (SELECT unnest([NULL, errule_code]) AS p) b),
rv{s} AS (SELECT DISTINCT entity_id, related_id, match_type, k, p FROM dir{s}, LATERAL (SELECT unnest([NULL, match_key, rev_match_key]) AS k) a, LATERAL (SELECT unnest([NULL, errule_code]) AS p) b),
rs{s} AS (SELECT DISTINCT d.entity_id, d.related_id, r.data_source AS source2 FROM dir{s} d JOIN {rec} r ON r.entity_id = d.related_id),
sp{s} AS (SELECT rs{s}.entity_id, related_id, data_source AS source1, source2, records FROM rs{s} JOIN src{s} USING (entity_id)),
c1{s} AS (SELECT {row.format('DSS', "'ENTITY_COUNT'", 'data_source', 'data_source', 0, 1, 'records', 0)} FROM src{s}),
c2{s} AS (SELECT {row.format('DSS', "'UNMATCHED_COUNT'", 'data_source', 'data_source', 0, 1, 1, 0)} FROM {rec} JOIN cnt{s} USING (entity_id) WHERE record_count = 1),
c3{s} AS (SELECT {row.format('DSS', matched, 'data_source', 'data_source', 0, 1, 'records', 0)} FROM src{s} JOIN mv{s} USING (entity_id) WHERE records > 1),
c4{s} AS (SELECT {row.format('CSS', matched, 'a.data_source', 'b.data_source', 0, 1, 'a.records', 0).replace('entity_id', 'a.entity_id')}
  FROM src{s} a JOIN src{s} b ON a.entity_id = b.entity_id AND a.data_source <> b.data_source JOIN mv{s} ON mv{s}.entity_id = a.entity_id),
c5{s} AS (SELECT DISTINCT {related}, 0 AS related_id, 1 AS entities, records, 0 AS relations FROM rv{s} JOIN sp{s} USING (entity_id, related_id)),
c6{s} AS (SELECT {related}, related_id, 0 AS entities, 0 AS records, 1 AS relations FROM rv{s} JOIN sp{s} USING (entity_id, related_id)),
c7{s} AS (SELECT {row.format('ESB', 'CAST(record_count AS VARCHAR)', 'NULL', 'NULL', 0, 1, 0, 0)} FROM cnt{s}),
c8{s} AS (SELECT {row.format('ERB', 'CAST(relation_count AS VARCHAR)', 'NULL', 'NULL', 0, 1, 0, 0)} FROM cnt{s}),
con{s} AS ({' UNION ALL '.join(f'SELECT * FROM c{i}{s}' for i in range(1, 9))}),
rep{s} AS (SELECT {KEY} AS report_key, report, statistic, source1, source2, sum(entities) AS entity_count, sum(records) AS record_count, sum(relations) AS relation_count FROM con{s} GROUP BY ALL),
det{s} AS (SELECT {KEY} AS report_key, report, statistic, source1, source2, entity_id, related_id, sum(CASE WHEN related_id = 0 THEN entities ELSE relations END) AS stat_count FROM con{s} GROUP BY ALL),
sets{s} AS (SELECT entity_id, list_sort(list(DISTINCT data_source)) AS sources FROM {rec} GROUP BY ALL),
flr{s} AS (SELECT d.*, o.sources AS own, t.sources AS theirs FROM dir{s} d LEFT JOIN sets{s} o ON o.entity_id = d.entity_id LEFT JOIN sets{s} t ON t.entity_id = d.related_id),
rl{s} AS (SELECT entity_id, list_sort(list(concat_ws('|', data_source, record_id, coalesce(match_key, '-'), coalesce(errule_code, '-')))) AS rl FROM {rec} GROUP BY ALL),
ll{s} AS (SELECT entity_id, list_sort(list(concat_ws('|', related_id, match_type, match_key, errule_code, CAST(theirs AS VARCHAR)))) AS ll FROM flr{s} GROUP BY ALL),
ent{s} AS (SELECT entity_id, entity_name, record_count, relation_count, rl, ll FROM cnt{s} JOIN rl{s} USING (entity_id) LEFT JOIN ll{s} USING (entity_id) LEFT JOIN {names} USING (entity_id))"""


DIFFS = """
rd AS (SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.data_source, n.data_source) AS data_source, coalesce(o.record_id, n.record_id) AS record_id,
  CASE WHEN o.entity_id IS NULL THEN 'added' WHEN n.entity_id IS NULL THEN 'removed'
    WHEN o.match_key IS DISTINCT FROM n.match_key OR o.errule_code IS DISTINCT FROM n.errule_code THEN 'changed' END AS kind
  FROM fx_records_old o FULL JOIN fx_records_new n ON o.entity_id = n.entity_id AND o.data_source = n.data_source AND o.record_id = n.record_id),
ld AS (SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.related_id, n.related_id) AS related_id,
  CASE WHEN o.entity_id IS NULL THEN 'added' WHEN n.entity_id IS NULL THEN 'removed'
    WHEN o.match_type IS DISTINCT FROM n.match_type OR o.match_key IS DISTINCT FROM n.match_key OR o.errule_code IS DISTINCT FROM n.errule_code
      OR o.own IS DISTINCT FROM n.own OR o.theirs IS DISTINCT FROM n.theirs THEN 'changed' END AS kind
  FROM flr_old o FULL JOIN flr_new n ON o.entity_id = n.entity_id AND o.related_id = n.related_id),
delta AS (SELECT report, statistic, source1, source2, entity_id, related_id, sum(entities) AS entities, sum(records) AS records, sum(relations) AS relations
  FROM (SELECT * FROM con_new UNION ALL SELECT report, statistic, source1, source2, entity_id, related_id, -entities, -records, -relations FROM con_old)
  GROUP BY ALL HAVING sum(entities) <> 0 OR sum(records) <> 0 OR sum(relations) <> 0),
gone AS (SELECT entity_id, data_source, record_id FROM rd WHERE kind = 'removed'),
orphaned AS (SELECT o.data_source, o.record_id, CASE WHEN g.entity_id IS NULL THEN o.entity_id ELSE 0 END AS entity_id, g.entity_id AS prev_entity_id, o.match_key, o.errule_code
  FROM fx_records_old o LEFT JOIN gone g USING (entity_id, data_source, record_id)),
outcomes AS (SELECT o.data_source, o.record_id, CASE WHEN n.entity_id IS NULL THEN 'delete' WHEN n.entity_id NOT IN (SELECT entity_id FROM fx_records_old) THEN 'follow_up' ELSE 'attach' END AS outcome, n.entity_id
  FROM orphaned o LEFT JOIN fx_records_new n USING (data_source, record_id) WHERE o.entity_id = 0)"""

MESSAGES = """
body AS (SELECT event_id, trim(body) AS b, try_cast(trim(body) AS JSON) AS j FROM fx_messages),
whole AS (SELECT event_id, b, CASE WHEN json_type(j) = 'OBJECT' THEN [j] WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) END AS ms FROM body),
ms AS (SELECT event_id, CAST(i - 1 AS INT) AS number, ms[i] AS m FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM whole)),
parsed AS (SELECT event_id, number, m, coalesce(m->>'DATA_SOURCE', m->>'dataSource') AS data_source, coalesce(m->>'RECORD_ID', m->>'recordId') AS record_id,
  list_transform(coalesce(CAST(m->'$.AFFECTED_ENTITIES[*].ENTITY_ID' AS VARCHAR[]), []) || coalesce(CAST(m->'$.affectedEntities[*].entityId' AS VARCHAR[]), []), lambda x: TRY_CAST(x AS BIGINT)) AS affected FROM ms),
aff AS (SELECT event_id, number, unnest(list_filter(list_distinct(affected), lambda x: x IS NOT NULL)) AS entity_id FROM parsed),
inter AS (SELECT event_id, number, unnest(CAST(m->'$.INTERESTING_ENTITIES.ENTITIES' AS JSON[])) AS e FROM parsed),
notes AS (SELECT event_id, number, unnest(coalesce(CAST(m->'$.INTERESTING_ENTITIES.NOTICES' AS JSON[]), []) || coalesce(CAST(m->'$.NOTICES' AS JSON[]), [])) AS n FROM parsed)"""

PRELUDE = f"WITH {common_tables()},{_state('fx_records', 'fx_relations', '')},{_state('fx_records_old', 'fx_relations_old', '_old', 'fx_names_old')},{_state('fx_records_new', 'fx_relations_new', '_new')},{DIFFS},{MESSAGES}"

ROWS = "report, statistic, source1, source2, entity_id, related_id, entities, records, relations"
REPORT = "report_key, report, statistic, source1, source2, entity_count, record_count, relation_count"
FLAT = """SELECT entity_id, 0 AS related_id, data_source, record_id, NULL::VARCHAR AS match_type, match_key, errule_code FROM fx_records
UNION ALL SELECT entity_id, related_id, NULL, NULL, match_type, match_key, errule_code FROM dir"""
KIND_LIST = ", ".join(f"'{k}'" for k in KINDS)


def _counts(where: str = "true") -> str:
    of = lambda stat, c: f"coalesce(sum({c}) FILTER (statistic = '{stat}'), 0)"
    return f"""SELECT source1 AS data_source, {of('ENTITY_COUNT', 'entity_count')} AS entity_count, {of('ENTITY_COUNT', 'record_count')} AS record_count, {of('UNMATCHED_COUNT', 'entity_count')} AS unmatched_count
FROM rep WHERE report = 'DSS' AND statistic IN ('ENTITY_COUNT', 'UNMATCHED_COUNT') AND {where} GROUP BY ALL"""


def _loaded(extra: str = "") -> str:
    each = f"SELECT data_source, coalesce(entity_count, 0) AS entity_count, coalesce(record_count, 0) AS record_count, coalesce(unmatched_count, 0) AS unmatched_count FROM (SELECT data_source FROM c {extra}) LEFT JOIN c USING (data_source)"
    return f""", c AS ({_counts()}), each AS ({each})
SELECT * FROM each UNION ALL SELECT NULL, (SELECT sum(entity_count) FROM rep WHERE report = 'ESB'), sum(record_count), sum(unmatched_count) FROM each"""


CROSS = f""", parts AS (SELECT source1, source2, string_split(statistic, ':') AS t, entity_count, record_count, relation_count FROM rep
  WHERE report IN ('DSS', 'CSS') AND statistic NOT IN ('ENTITY_COUNT', 'UNMATCHED_COUNT') AND (entity_count <> 0 OR record_count <> 0 OR relation_count <> 0)),
crs AS (SELECT source1, source2, t[1] AS statistic, nullif(t[2], '') AS principle, nullif(array_to_string(t[3:], ':'), '') AS match_key, entity_count, record_count, relation_count FROM parts),
kinds AS (SELECT unnest([{KIND_LIST}]) AS statistic)"""


def _filled(pairs: str, key: str, principle: str, kinds: str = "kinds") -> str:
    """Cross rows over ``pairs`` with zeros; key and principle: ``*`` or null."""
    want = " AND ".join(["true"] + [f"{c} IS NULL" for c, v in (("match_key", key), ("principle", principle)) if v != "*"])
    return f"""SELECT q.source1, q.source2, q.statistic, principle, match_key, coalesce(entity_count, 0) AS entity_count, coalesce(record_count, 0) AS record_count, coalesce(relation_count, 0) AS relation_count
FROM (SELECT * FROM ({pairs}), {kinds}) q LEFT JOIN (SELECT * FROM crs WHERE {want}) c USING (source1, source2, statistic)"""


def _summaries(own: str, others: str, key: str, principle: str) -> str:
    pairs = f"SELECT source1, source2 FROM ({own}) a(source1), ({others}) b(source2)"
    return f"""{CROSS}, c AS ({_counts()}), f AS ({_filled(pairs, key, principle)})
SELECT f.*, coalesce(c.entity_count, 0) AS source_entities, coalesce(c.record_count, 0) AS source_records, coalesce(c.unmatched_count, 0) AS source_unmatched FROM f LEFT JOIN c ON c.data_source = f.source1"""


LOADED = "SELECT source1 AS s FROM rep WHERE report = 'DSS' AND statistic = 'ENTITY_COUNT' AND record_count > 0"


def _listed(entity: str) -> str:
    return f"(SELECT string_agg(concat_ws('|', data_source, record_id, coalesce(match_key, ''), coalesce(errule_code, '')), ',' ORDER BY data_source, record_id) FROM fx_records r WHERE r.entity_id = {entity})"


def _page(key: str, names: list[str], op: str, bound: str, size: int) -> str:
    order = ", ".join(f"{n} {'ASC' if op[0] == '>' else 'DESC'}" for n in names)
    columns, row = ", ".join(names), f"({', '.join(names)})" if len(names) > 1 else names[0]
    some = "related_id <> 0" if len(names) > 1 else "related_id = 0"
    text = lambda end: " || ':' || ".join(f"CAST({end}_{n} AS VARCHAR)" for n in names)
    first = lambda end, d: ", ".join(f"(SELECT {n} FROM pg ORDER BY {', '.join(f'{m} {d}' for m in names)} LIMIT 1) AS {end}_{n}" for n in names)
    low = f"({', '.join(f'low_{n}' for n in names)})" if len(names) > 1 else f"low_{names[0]}"
    return f""", ks AS (SELECT {columns} FROM det WHERE report_key = {key} AND {some}), pg AS (SELECT * FROM ks WHERE {row} {op} {bound} ORDER BY {order} LIMIT {size}),
ends AS (SELECT {first('low', 'ASC')}, {first('high', 'DESC')}),
around AS (SELECT (SELECT count(*) FROM ks) AS total, (SELECT count(*) FROM ks, ends WHERE {row} < {low}) AS before, {text('low')} AS page_min, {text('high')} AS page_max FROM ends)"""


AROUND = "total, before, total - before - (SELECT count(*) FROM pg) AS after, page_min, page_max"


def _entities(key: str, op: str, bound: int, size: int) -> str:
    return f"""{_page(key, ['entity_id'], op, str(bound), size)}
SELECT pg.entity_id, entity_name, record_count, relation_count, {_listed('pg.entity_id')} AS records, {AROUND} FROM pg LEFT JOIN ent USING (entity_id), around"""


def _relations(key: str, op: str, bound: tuple[int, int], size: int) -> str:
    return f"""{_page(key, ['entity_id', 'related_id'], op, str(bound), size)}
SELECT pg.entity_id, pg.related_id, x.match_type, CASE WHEN pg.related_id < pg.entity_id THEN x.rev_match_key ELSE x.match_key END AS match_key, x.errule_code, e.entity_name, {_listed('pg.entity_id')} AS records,
  f.entity_name AS related_entity_name, {_listed('pg.related_id')} AS related_records, {AROUND}
FROM pg LEFT JOIN fx_relations x ON x.entity_id = least(pg.entity_id, pg.related_id) AND x.related_id = greatest(pg.entity_id, pg.related_id)
LEFT JOIN ent e ON e.entity_id = pg.entity_id LEFT JOIN ent f ON f.entity_id = pg.related_id, around"""


def _key(kind: str, source1: str, source2: str) -> str:
    code = "DSS" if source1 == source2 else "CSS"
    return f"'{code}:{kind}:' || {_enc(repr(source1))} || ':' || {_enc(repr(source2))}"


MAX = 2**63 - 1
STATS = ", ".join(f"'{t}_COUNT'" for t in MATCH_TYPES)

SQL = {
    "parse_messages": "SELECT event_id, number, data_source, record_id, len(affected) AS n_affected FROM parsed",
    "dead_letters": "SELECT event_id, b AS body FROM whole WHERE ms IS NULL AND b <> '' UNION SELECT w.event_id, w.b FROM whole w JOIN parsed p USING (event_id) WHERE len(list_filter(affected, lambda x: x IS NULL)) > 0",
    "affected_entities": "SELECT * FROM aff",
    "touched_records": "SELECT event_id, number, trim(data_source) AS data_source, trim(record_id) AS record_id FROM parsed WHERE trim(data_source) <> '' AND trim(record_id) <> ''",
    "interesting_entities": """SELECT event_id, number, CAST(e->>'ENTITY_ID' AS BIGINT) AS entity_id, CAST(e->>'DEGREES' AS INT) AS degrees, e->'FLAGS'->>0 AS flags,
        e->'SAMPLE_RECORDS'->0->>'DATA_SOURCE' AS data_source, e->'SAMPLE_RECORDS'->0->>'RECORD_ID' AS record_id, e->'SAMPLE_RECORDS'->0->'FLAGS'->>0 AS sample_flags FROM inter""",
    "notices": "SELECT event_id, number, n->>'CODE' AS code, n->>'DESCRIPTION' AS description FROM notes",
    "message_multiplicity": "SELECT entity_id, count(*) AS multiplicity FROM aff GROUP BY ALL",
    "parse_snapshots_engine": FLAT,
    "parse_snapshots_stored": FLAT,
    "snapshot_records": "SELECT entity_id, data_source, record_id, match_key, errule_code FROM fx_records",
    "snapshot_relations": "SELECT entity_id, related_id, match_type, match_key, errule_code FROM dir",
    "source_summary": "SELECT * FROM src",
    "classify_match": "SELECT entity_id, related_id, match_type FROM dir",
    "latest_snapshots": "SELECT entity_id, max(version) AS version FROM (SELECT entity_id, 1 AS version FROM fx_records_old UNION ALL SELECT entity_id, 2 FROM fx_records_new) GROUP BY ALL",
    "missing_match_keys": "SELECT DISTINCT entity_id FROM dir WHERE match_type = 'POSSIBLE_MATCH'",
    "reverse_match_keys": f"""SELECT entity_id, related_id, match_key,
        array_to_string(list_transform(regexp_extract_all(trim(match_key), '{COMPONENT}', 0), lambda x: regexp_replace(x, '{SWAP}', '\\1(\\3:\\2)\\4')), '') AS reversed FROM fx_relations""",
    "orient_relations": "SELECT entity_id, related_id, match_type, match_key, rev_match_key, errule_code FROM fx_relations",
    "report_keys": "SELECT report_key, report, statistic, source1, source2 FROM rep",
    "statistic_strings": f"SELECT DISTINCT {STAT.format(base='match_type || ' + chr(39) + '_COUNT' + chr(39))} AS text, match_type || '_COUNT' AS statistic, p AS principle, k AS match_key FROM rv",
    "snapshot_names": "SELECT entity_id, entity_name FROM ent",
    "related_records": "SELECT d.entity_id, d.related_id, entity_name AS related_name, data_source, record_id FROM dir d LEFT JOIN fx_records r ON r.entity_id = d.related_id LEFT JOIN ent e ON e.entity_id = r.entity_id",
    "self_relations": "SELECT DISTINCT entity_id FROM fx_records WHERE entity_id % 7 = 0",
    "fingerprints": """SELECT entity_id, count(*) AS states, count(DISTINCT row(entity_name, rl, ll)) AS hashes
        FROM (SELECT * FROM ent_old UNION ALL SELECT * FROM ent_new) GROUP BY ALL""",
    "match_pair_variants": "SELECT entity_id, k AS match_key, p AS principle FROM mv",
    "relation_variants": "SELECT entity_id, related_id, match_type, k AS match_key, p AS principle FROM rv",
    "source_pairs": "SELECT entity_id, related_id, source1, source2, records FROM sp",
    "records_diff": "SELECT * FROM rd WHERE kind IS NOT NULL",
    "relations_diff": "SELECT * FROM ld WHERE kind IS NOT NULL",
    "source_deltas": "SELECT entity_id, data_source, sum(n) AS delta FROM (SELECT entity_id, data_source, records AS n FROM src_new UNION ALL SELECT entity_id, data_source, -records FROM src_old) GROUP BY ALL HAVING sum(n) <> 0",
    "entity_count_deltas": """SELECT entity_id, sum(r) AS record_delta, sum(l) AS relation_delta FROM (SELECT entity_id, record_count AS r, relation_count AS l FROM cnt_new
        UNION ALL SELECT entity_id, -record_count, -relation_count FROM cnt_old) GROUP BY ALL HAVING sum(r) <> 0 OR sum(l) <> 0""",
    "unchanged_entities": "SELECT o.entity_id FROM ent_old o JOIN ent_new n ON o.entity_id = n.entity_id AND o.rl = n.rl AND o.ll IS NOT DISTINCT FROM n.ll AND o.entity_name IS NOT DISTINCT FROM n.entity_name",
    "upsert_entities": """SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, CASE WHEN n.entity_id IS NULL THEN o.entity_name ELSE n.entity_name END AS entity_name, coalesce(n.record_count, o.record_count) AS record_count,
        coalesce(n.relation_count, o.relation_count) AS relation_count, x.changed, CASE WHEN o.entity_id IS NULL THEN 'second' ELSE 'load' END AS creator_id,
        CASE WHEN o.entity_id IS NULL OR x.changed THEN 'second' ELSE 'load' END AS modifier_id
        FROM ent_old o FULL JOIN ent_new n ON o.entity_id = n.entity_id, LATERAL (SELECT o.entity_id IS NOT NULL AND n.entity_id IS NOT NULL AND (o.rl <> n.rl OR o.ll IS DISTINCT FROM n.ll OR o.entity_name IS DISTINCT FROM n.entity_name) AS changed) x""",
    "delete_entities": "SELECT entity_id, record_count, relation_count FROM ent_old WHERE entity_id IN (SELECT entity_id FROM fx_records_new)",
    "upsert_records": """SELECT coalesce(n.data_source, o.data_source) AS data_source, coalesce(n.record_id, o.record_id) AS record_id, coalesce(n.entity_id, o.entity_id) AS entity_id,
        CASE WHEN n.entity_id IS NULL THEN o.match_key ELSE n.match_key END AS match_key, CASE WHEN n.entity_id IS NULL THEN o.errule_code ELSE n.errule_code END AS errule_code,
        CASE WHEN x.change = 'move' THEN o.entity_id END AS prev_entity_id, CASE WHEN x.change = 'insert' THEN 'second' ELSE 'load' END AS creator_id,
        CASE WHEN x.change IS NULL THEN 'load' ELSE 'second' END AS modifier_id, x.change
        FROM fx_records_old o FULL JOIN fx_records_new n ON o.data_source = n.data_source AND o.record_id = n.record_id, LATERAL (SELECT CASE WHEN o.entity_id IS NULL THEN 'insert' WHEN n.entity_id IS NULL THEN NULL
          WHEN o.entity_id <> n.entity_id THEN 'move' WHEN o.match_key IS DISTINCT FROM n.match_key OR o.errule_code IS DISTINCT FROM n.errule_code THEN 'update' END AS change) x""",
    "orphan_records": "SELECT data_source, record_id, entity_id, prev_entity_id, CASE WHEN entity_id = 0 THEN 'second' ELSE 'load' END AS modifier_id FROM orphaned",
    "resolve_orphans": "SELECT * FROM outcomes",
    "apply_orphans": """SELECT o.data_source, o.record_id, CASE WHEN x.outcome = 'attach' THEN x.entity_id ELSE o.entity_id END AS entity_id,
        CASE WHEN x.outcome = 'attach' THEN n.match_key ELSE o.match_key END AS match_key, CASE WHEN x.outcome = 'attach' THEN n.errule_code ELSE o.errule_code END AS errule_code,
        CASE WHEN x.outcome = 'attach' THEN 'third' END AS adopter_id
        FROM orphaned o LEFT JOIN outcomes x USING (data_source, record_id) LEFT JOIN fx_records_new n USING (data_source, record_id) WHERE x.outcome IS DISTINCT FROM 'delete'""",
    "upsert_relations": """SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, coalesce(n.related_id, o.related_id) AS related_id, coalesce(n.match_type, o.match_type) AS match_type, coalesce(n.match_key, o.match_key) AS match_key,
        coalesce(n.rev_match_key, o.rev_match_key) AS rev_match_key, coalesce(n.errule_code, o.errule_code) AS errule_code, x.changed, CASE WHEN o.entity_id IS NULL OR x.changed THEN 'second' ELSE 'load' END AS modifier_id
        FROM fx_relations_old o FULL JOIN fx_relations_new n ON o.entity_id = n.entity_id AND o.related_id = n.related_id,
        LATERAL (SELECT o.entity_id IS NOT NULL AND n.entity_id IS NOT NULL AND (o.match_type <> n.match_type OR o.match_key <> n.match_key OR o.rev_match_key <> n.rev_match_key OR o.errule_code <> n.errule_code) AS changed) x""",
    "delete_relations": "SELECT entity_id, related_id FROM fx_relations_old o WHERE EXISTS (SELECT 1 FROM fx_relations_new n WHERE n.entity_id = o.entity_id AND n.related_id = o.related_id)",
    "stale_relations": """, own AS (SELECT DISTINCT entity_id FROM fx_records_new), a AS (SELECT entity_id, related_id FROM dir_old SEMI JOIN own USING (entity_id)), b AS (SELECT entity_id, related_id FROM dir_new SEMI JOIN own USING (entity_id))
        SELECT *, 'unknown' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "follow_ups": """, moved AS (SELECT coalesce(o.entity_id, n.entity_id) AS entity_id FROM sets_old o FULL JOIN sets_new n ON o.entity_id = n.entity_id WHERE o.sources IS DISTINCT FROM n.sources),
        f AS (SELECT entity_id, related_id FROM ld WHERE kind IS NOT NULL UNION ALL SELECT entity_id, related_id FROM dir_new SEMI JOIN moved USING (entity_id))
        SELECT entity_id FROM f UNION SELECT related_id FROM f""",
    "contribution_deltas": f"SELECT {ROWS} FROM delta",
    "rebuild_report": f"SELECT {REPORT} FROM rep",
    "rebuild_detail": "SELECT * FROM det WHERE stat_count <> 0",
    "rollup_pending": f"""SELECT * FROM (SELECT {KEY} AS report_key, report, statistic, source1, source2, sum(entities) AS entity_count, sum(records) AS record_count, sum(relations) AS relation_count FROM delta GROUP BY ALL)
        WHERE entity_count <> 0 OR record_count <> 0 OR relation_count <> 0""",
    "merge_report": f"SELECT {REPORT} FROM rep_new UNION ALL SELECT report_key, report, statistic, source1, source2, 0, 0, 0 FROM rep_old WHERE report_key NOT IN (SELECT report_key FROM rep_new)",
    "merge_detail": "SELECT * FROM det_new WHERE stat_count <> 0",
    "reconcile": """SELECT * FROM (SELECT coalesce(o.report_key, n.report_key) AS report_key, coalesce(o.entity_count, 0) AS kept_entity_count, coalesce(o.record_count, 0) AS kept_record_count, coalesce(o.relation_count, 0) AS kept_relation_count,
        coalesce(n.entity_count, 0) AS rebuilt_entity_count, coalesce(n.record_count, 0) AS rebuilt_record_count, coalesce(n.relation_count, 0) AS rebuilt_relation_count FROM rep_old o FULL JOIN rep_new n ON o.report_key = n.report_key)
        WHERE kept_entity_count <> rebuilt_entity_count OR kept_record_count <> rebuilt_record_count OR kept_relation_count <> rebuilt_relation_count""",
    "loaded_stats": _loaded(),
    "loaded_stats_all_sources": _loaded("UNION SELECT unnest(['CUSTOMERS', 'WATCHLIST'])"),
    "source_loaded_stats": _counts(f"source1 = '{TWO}'"),
    "size_breakdown": "SELECT CAST(statistic AS INT) AS entity_size, entity_count FROM rep WHERE report = 'ESB'",
    "size_count": "SELECT 3 AS entity_size, coalesce(sum(entity_count), 0) AS entity_count FROM rep WHERE report = 'ESB' AND statistic = '3'",
    "relations_breakdown": "SELECT CAST(statistic AS INT) AS relations_count, entity_count FROM rep WHERE report = 'ERB'",
    "relations_count": "SELECT 4 AS relations_count, coalesce(sum(entity_count), 0) AS entity_count FROM rep WHERE report = 'ERB' AND statistic = '4'",
    "loaded_sources": LOADED.replace(" AS s ", " AS data_source "),
    "summary_stats": _summaries(LOADED, LOADED, "*", "*"),
    "summary_stats_all_sources": _summaries(f"{LOADED} UNION SELECT 'WATCHLIST'", f"{LOADED} UNION SELECT 'WATCHLIST'", "", ""),
    "source_summary_report": _summaries(f"SELECT '{ONE}'", LOADED, "*", ""),
    "cross_summary": CROSS + _filled(f"SELECT '{ONE}' AS source1, '{TWO}' AS source2", "*", "*"),
    "source_entities": _entities(_key("ENTITY_COUNT", TWO, TWO), ">=", 10, 40),
    "size_entities": _entities("'ESB:2'", "<=", 60000, 10),
    "relations_entities": _entities("'ERB:2'", "<", 1000, 10),
    "sampled_entities_page": f"""{_page(_key('ENTITY_COUNT', BASE, BASE), ['entity_id'], '>', '0', 50)}, few AS (SELECT entity_id FROM pg ORDER BY md5('11:' || entity_id), entity_id LIMIT 5)
        SELECT few.entity_id, entity_name, record_count, relation_count, {_listed('few.entity_id')} AS records, {AROUND} FROM few LEFT JOIN ent USING (entity_id), around""",
    "relations_page_max": _relations(_key("DISCLOSED_RELATION_COUNT", BASE, BASE), "<", (MAX, MAX), 15),
    "page_record_chunks": f"""{_page(_key('ENTITY_COUNT', TWO, TWO), ['entity_id'], '>=', '10', 40)}, placed AS (SELECT *, (row_number() OVER (PARTITION BY entity_id ORDER BY data_source, record_id) - 1) // 2 AS chunk FROM fx_records WHERE entity_id IN (SELECT entity_id FROM pg))
SELECT entity_id, chunk, string_agg(concat_ws('|', data_source, record_id, coalesce(match_key, ''), coalesce(errule_code, '')), ',' ORDER BY data_source, record_id) AS records FROM placed GROUP BY entity_id, chunk""",
    "page_header_empty": f"{_page(_key('ENTITY_COUNT', TWO, TWO), ['entity_id'], '>=', '9000000000000', 40)} SELECT {AROUND}, (SELECT count(*) FROM pg) AS shown FROM around",
    "page_header_relations": f"{_page(_key('DISCLOSED_RELATION_COUNT', BASE, BASE), ['entity_id', 'related_id'], '<', str((MAX, MAX)), 15)} SELECT {AROUND}, (SELECT count(*) FROM pg) AS shown FROM around",
    "normalised_keys": "SELECT data_source, record_id, match_key FROM fx_records",
    "report_json": """SELECT '{"entity_size":' || statistic || ',"entity_count":' || entity_count || '}' AS json FROM rep WHERE report = 'ESB'""",
    "write_mart_versions": f"SELECT {REPORT} FROM rep_new",
    "stream_ingest": "SELECT entity_id, count(*) AS multiplicity FROM aff GROUP BY ALL",
    "stream_collapse": "SELECT entity_id, count(*) AS multiplicity FROM aff GROUP BY ALL",
    "stream_refresh": f"SELECT {REPORT} FROM rep_new",
}
def _waiting(tick: int, ticks: int, quiet: int, longest: int, most: int) -> str:
    """Requests by tick: those that still wait after one, and those taken at the next."""
    second = f"event_id % {tick * ticks}"
    ctes = ["w0 AS (SELECT NULL::BIGINT AS entity_id, NULL::BIGINT AS asked_on, NULL::BIGINT AS again_on, NULL::BIGINT AS n WHERE false)"]
    for k in range(ticks):
        now = tick * k
        new = f"SELECT entity_id, {now} AS asked_on, {now} AS again_on, 1 AS n FROM aff WHERE {second} >= {now} AND {second} < {now + tick}"
        ctes.append(f"a{k} AS MATERIALIZED (SELECT entity_id, min(asked_on) AS asked_on, max(again_on) AS again_on, sum(n) AS n FROM (SELECT * FROM w{k} UNION ALL {new}) GROUP BY entity_id)")
        ctes.append(f"d{k} AS MATERIALIZED (SELECT * FROM a{k} WHERE {now} - again_on > {quiet} OR {now} - asked_on > {longest} ORDER BY asked_on, entity_id LIMIT {most})")
        ctes.append(f"w{k + 1} AS (SELECT * FROM a{k} WHERE entity_id NOT IN (SELECT entity_id FROM d{k}))")
    return f", {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {k} AS tick, entity_id, CAST(n AS BIGINT) AS multiplicity FROM d{k}" for k in range(ticks))


#: As in the queries: messages of a batch; seconds between ticks and their number; the default delays.
SQL["stream_queue"] = "SELECT event_id AS message_id, octet_length(encode(body)) AS body_bytes, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 3000 AS INT) AS batch FROM fx_messages"
SQL["waiting_requests"] = _waiting(15, 8, 10, 60, 100)
FOLLOWED = f"""WITH {common_tables()}, tie AS (SELECT unnest(range(2, 42, 4)) AS a), rec AS (SELECT * REPLACE (CASE WHEN entity_id % 100 <> 0 THEN match_key END AS match_key) FROM fx_records),
rel AS (SELECT * FROM fx_relations WHERE NOT EXISTS (SELECT 1 FROM tie WHERE entity_id = a AND related_id = a + 4) UNION ALL SELECT a, a + 4, 'POSSIBLE_MATCH', '+TIE', '+TIE', 'T' FROM tie),
{_state('rec', 'rel', '')} SELECT {REPORT} FROM rep"""
for number, name in enumerate(("entity_count", "unmatched", "matched", "cross_matched", "relation_entities", "relation_pairs", "sizes", "relation_counts"), 1):
    SQL[f"contrib_{name}"] = f"SELECT {ROWS} FROM c{number}"
for name, kind in zip(("match", "ambiguous", "possible_match", "possible_relation", "disclosed"), KINDS):
    SQL[f"cross_{name}_summary"] = CROSS + _filled(f"SELECT '{BASE}' AS source1, '{ONE}' AS source2", "", "*", f"(SELECT '{kind}' AS statistic)")
    SQL[f"cross_entities_{name}"] = _entities(_key(kind, BASE, ONE), ">", 20, 30)
    own = ONE if kind == "MATCHED_COUNT" else BASE
    SQL[f"summary_entities_{name}"] = _entities(_key(kind, own, own), "<", MAX, 25)
    if name != "match":
        SQL[f"cross_relations_{name}"] = _relations(_key(kind, BASE, ONE), ">=", (30, 40), 20)

ORACLES = {"stream_refresh_follow": FOLLOWED} | {name: f"{PRELUDE}{'' if sql.lstrip().startswith(',') else ' '}{sql}" for name, sql in SQL.items()}

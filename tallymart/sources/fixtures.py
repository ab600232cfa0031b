"""Entity views that are derived from the base tables: records, relations, two states of both, and a message feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Customers and their orders, suppliers that share entities with some, and parts: entities of one record and without relations.
RECORDS = """
SELECT c_custkey + 1 AS entity_id, 'CUSTOMERS' AS data_source, 'C' || c_custkey AS record_id,
       CAST(NULL AS STRING) AS match_key, CAST(NULL AS STRING) AS errule_code
FROM {customer}
UNION ALL
SELECT o_custkey + 1, CASE WHEN o_orderkey % 3 = 0 THEN 'ORDERS WEB' ELSE 'ORDERS_STORE' END, 'O' || o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN '+NAME+ADDRESS' WHEN 'O' THEN '+NAME+PHONE' ELSE '+NAME+DOB-GENDER' END,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'SF1_' || substr(o_orderpriority, 1, 1) END
FROM {orders}
UNION ALL
SELECT s_suppkey * 10 + 1, 'SUPPLIERS', 'S' || s_suppkey, '+NAME+TAX_ID', 'SF2' FROM {supplier}
UNION ALL
SELECT 1000000000 + p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'SUPPLIERS' ELSE 'ORDERS_STORE' END, 'P' || p_partkey, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {part}
"""
RELATIONS = """
WITH w AS (
  SELECT c_custkey + 1 AS entity_id,
         lead(c_custkey, 1) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) + 1 AS r1,
         lead(c_custkey, 3) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) + 1 AS r3
  FROM {customer}),
p AS (SELECT entity_id, r1 AS related_id FROM w WHERE r1 IS NOT NULL
      UNION ALL SELECT entity_id, r3 FROM w WHERE r3 IS NOT NULL)
SELECT entity_id, related_id,
  CASE (entity_id + related_id) % 4 WHEN 0 THEN 'AMBIGUOUS_MATCH' WHEN 1 THEN 'POSSIBLE_MATCH'
       WHEN 2 THEN 'POSSIBLE_RELATION' ELSE 'DISCLOSED_RELATION' END AS match_type,
  CASE (entity_id + related_id) % 4 WHEN 0 THEN '+SSN (Ambiguous)' WHEN 1 THEN '+NAME+ADDRESS' WHEN 2 THEN '+ADDRESS-DOB'
       ELSE CASE entity_id % 3 WHEN 0 THEN '+REL_POINTER(HUSBAND:WIFE)'
                               WHEN 1 THEN '+NAME+ADDRESS+REL_POINTER(:SUBSIDIARY_OF)'
                               ELSE '+REL_POINTER(GLOBAL' || chr(92) || ':PARENT:)' END END AS match_key,
  CASE (entity_id + related_id) % 4 WHEN 0 THEN '+SSN (Ambiguous)' WHEN 1 THEN '+NAME+ADDRESS' WHEN 2 THEN '+ADDRESS-DOB'
       ELSE CASE entity_id % 3 WHEN 0 THEN '+REL_POINTER(WIFE:HUSBAND)'
                               WHEN 1 THEN '+NAME+ADDRESS+REL_POINTER(SUBSIDIARY_OF:)'
                               ELSE '+REL_POINTER(:GLOBAL' || chr(92) || ':PARENT)' END END AS rev_match_key,
  CASE (entity_id + related_id) % 4 WHEN 3 THEN 'DISCLOSED' ELSE 'CNAME' || (entity_id % 2) END AS errule_code
FROM p
"""
#: Names of entities, now and before some were renamed; entities of suppliers alone have none.
NAMES = "SELECT c_custkey + 1 AS entity_id, CASE WHEN c_custkey % 17 <> 3 THEN c_name END AS entity_name FROM {customer}"
NAMES_OLD = "SELECT entity_id, CASE WHEN entity_id % 13 = 0 THEN 'Formerly ' || entity_name ELSE entity_name END AS entity_name FROM {fx_names}"
RECORDS_NEW = "SELECT * FROM {fx_records} WHERE entity_id % 25 <> 0"
RECORDS_OLD = """
SELECT CASE WHEN substr(record_id, 1, 1) = 'O' AND record_id LIKE '%00' THEN 1 ELSE entity_id END AS entity_id,
       data_source, record_id,
       CASE WHEN match_key IS NOT NULL AND entity_id % 7 = 0 THEN '+NAME' ELSE match_key END AS match_key, errule_code
FROM {fx_records} WHERE entity_id % 20 <> 0 AND record_id NOT LIKE 'O%5'
"""
RELATIONS_NEW = "SELECT * FROM {fx_relations} WHERE entity_id % 25 <> 0 AND related_id % 25 <> 0"
RELATIONS_OLD = """
SELECT entity_id, related_id, CASE WHEN entity_id % 11 = 0 THEN 'POSSIBLE_MATCH' ELSE match_type END AS match_type,
       match_key, rev_match_key, errule_code
FROM {fx_relations} WHERE entity_id % 20 <> 0 AND related_id % 20 <> 0 AND (entity_id + related_id) % 9 <> 0
"""
#: Message bodies: objects, arrays, junk and a wrong type in a right shape, with interesting entities and notices in both places and both spellings.
MESSAGES = """
SELECT event_id, ts,
  CASE WHEN event_id % 97 = 0 THEN 'not json'
       WHEN event_id % 89 = 0 THEN '{{"DATA_SOURCE":"CUSTOMERS","RECORD_ID":"C1","AFFECTED_ENTITIES":[{{"ENTITY_ID":"oops"}}]}}'
       WHEN event_id % 10 = 0 THEN '[' || m || ',' || m || ']' ELSE m END AS body
FROM (SELECT event_id, ts, CASE WHEN event_id % 4 = 3
    THEN '{{"dataSource":"CUSTOMERS","recordId":"C' || user_id || '","affectedEntities":[{{"entityId":' || (user_id + 1) || '}}]}}'
    ELSE '{{"DATA_SOURCE":"CUSTOMERS","RECORD_ID":"C' || user_id || '","AFFECTED_ENTITIES":[{{"ENTITY_ID":' || (user_id + 1) || '}}]'
      || CASE WHEN event_id % 3 = 0 THEN ',"INTERESTING_ENTITIES":{{"ENTITIES":[{{"ENTITY_ID":' || (user_id + 2) || ',"DEGREES":' || (event_id % 5)
         || ',"FLAGS":["' || event_type || '"],"SAMPLE_RECORDS":[{{"FLAGS":["' || event_type || '"],"DATA_SOURCE":"CUSTOMERS","RECORD_ID":"C' || (user_id + 1) || '"}}]}}]'
         || CASE WHEN event_id % 6 = 0 THEN ',"NOTICES":[{{"CODE":"' || event_type || '","DESCRIPTION":"inside ' || event_id || '"}}]' ELSE '' END || '}}' ELSE '' END
      || CASE WHEN event_id % 7 = 0 THEN ',"NOTICES":[{{"CODE":"' || event_type || '","DESCRIPTION":"top ' || event_id || '"}}]' ELSE '' END || '}}' END AS m
  FROM {events}) t
"""

VIEWS = {
    "fx_records": (RECORDS, ("customer", "orders", "supplier", "part")),
    "fx_relations": (RELATIONS, ("customer",)),
    "fx_names": (NAMES, ("customer",)),
    "fx_names_old": (NAMES_OLD, ("fx_names",)),
    "fx_records_new": (RECORDS_NEW, ("fx_records",)),
    "fx_records_old": (RECORDS_OLD, ("fx_records",)),
    "fx_relations_new": (RELATIONS_NEW, ("fx_relations",)),
    "fx_relations_old": (RELATIONS_OLD, ("fx_relations",)),
    "fx_messages": (MESSAGES, ("events",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a base table, over the Parquet files in ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def common_tables() -> str:
    """The views as SQL common table expressions over the base tables."""
    return ",\n".join(f"{name} AS ({sql.format(**{n: n for n in needs})})" for name, (sql, needs) in VIEWS.items())

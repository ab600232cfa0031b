"""Entity snapshots: two JSON dialects to one nested row, and nested rows to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import classify_match, normalise_blank

_KEYS = "ARRAY<STRUCT<DATA_SOURCE: STRING, RECORD_ID: STRING>>"
ENGINE = f"""RESOLVED_ENTITY STRUCT<ENTITY_ID: BIGINT, ENTITY_NAME: STRING,
RECORDS: ARRAY<STRUCT<DATA_SOURCE: STRING, RECORD_ID: STRING, MATCH_KEY: STRING, ERRULE_CODE: STRING>>>,
RELATED_ENTITIES ARRAY<STRUCT<ENTITY_ID: BIGINT, ENTITY_NAME: STRING, RECORDS: {_KEYS}, IS_AMBIGUOUS: INT, IS_DISCLOSED: INT,
MATCH_LEVEL_CODE: STRING, MATCH_KEY: STRING, ERRULE_CODE: STRING>>"""
STORED = """id BIGINT, name STRING, records ARRAY<STRUCT<src: STRING, id: STRING, mkey: STRING, rule: STRING>>,
related ARRAY<STRUCT<id: BIGINT, name: STRING, records: ARRAY<STRUCT<src: STRING, id: STRING>>, matchType: STRING, matchKey: STRING, principle: STRING>>"""


def parse_snapshots(feed: DataFrame, body: str = "body") -> DataFrame:
    """``feed`` with entity_id, entity_name, records and related, whichever dialect each body uses.

    Records are (data_source, record_id, match_key, errule_code); related entities are (related_id, entity_name, match_type,
    match_key, errule_code, records). Blank keys and rules are null. Bodies of neither dialect have a null entity_id.
    """
    rows = feed.withColumn("_e", F.from_json(body, ENGINE)).withColumn("_s", F.from_json(body, STORED))

    def record(r: Column, names: tuple[str, str, str, str]) -> Column:
        return F.struct(r[names[0]].alias("data_source"), r[names[1]].alias("record_id"), normalise_blank(r[names[2]]).alias("match_key"), normalise_blank(r[names[3]]).alias("errule_code"))

    key = lambda r, a, b: F.struct(r[a].alias("data_source"), r[b].alias("record_id"))
    records = F.coalesce(
        F.transform("_e.RESOLVED_ENTITY.RECORDS", lambda r: record(r, ("DATA_SOURCE", "RECORD_ID", "MATCH_KEY", "ERRULE_CODE"))),
        F.transform("_s.records", lambda r: record(r, ("src", "id", "mkey", "rule"))),
    )
    related = F.coalesce(
        F.transform(
            "_e.RELATED_ENTITIES",
            lambda r: F.struct(
                r["ENTITY_ID"].alias("related_id"), r["ENTITY_NAME"].alias("entity_name"), classify_match(r["IS_AMBIGUOUS"], r["IS_DISCLOSED"], r["MATCH_LEVEL_CODE"]).alias("match_type"),
                normalise_blank(r["MATCH_KEY"]).alias("match_key"), normalise_blank(r["ERRULE_CODE"]).alias("errule_code"), F.transform(r["RECORDS"], lambda k: key(k, "DATA_SOURCE", "RECORD_ID")).alias("records"),
            ),
        ),
        F.transform(
            "_s.related",
            lambda r: F.struct(
                r["id"].alias("related_id"), r["name"].alias("entity_name"), r["matchType"].alias("match_type"), normalise_blank(r["matchKey"]).alias("match_key"),
                normalise_blank(r["principle"]).alias("errule_code"), F.transform(r["records"], lambda k: key(k, "src", "id")).alias("records"),
            ),
        ),
    )
    return rows.select(
        *[c for c in feed.columns if c != body], F.coalesce("_e.RESOLVED_ENTITY.ENTITY_ID", "_s.id").alias("entity_id"), F.coalesce("_e.RESOLVED_ENTITY.ENTITY_NAME", "_s.name").alias("entity_name"),
        records.alias("records"), related.alias("related"),
    )


def latest(snapshots: DataFrame, version: str = "version") -> DataFrame:
    """The newest snapshot of each entity."""
    top = F.row_number().over(W.partitionBy("entity_id").orderBy(F.col(version).desc()))
    return snapshots.withColumn("_n", top).where("_n = 1").drop("_n")


def snapshot_records(snapshots: DataFrame) -> DataFrame:
    """(entity_id, data_source, record_id, match_key, errule_code): of a repeated record key in an entity the first counts."""
    each = snapshots.select("entity_id", F.posexplode("records").alias("at", "r")).select("entity_id", "at", "r.*")
    first = F.row_number().over(W.partitionBy("entity_id", "data_source", "record_id").orderBy("at"))
    return each.withColumn("n", first).where("n = 1").drop("n", "at")


def snapshot_names(snapshots: DataFrame) -> DataFrame:
    """(entity_id, entity_name) of every snapshot."""
    return snapshots.where("entity_id IS NOT NULL").select("entity_id", "entity_name")


def related_records(snapshots: DataFrame) -> DataFrame:
    """(entity_id, related_id, related_name, data_source, record_id): what snapshots say of related entities; null record parts where
    one lists none."""
    each = snapshots.select("entity_id", F.explode("related").alias("r"))
    each = each.select("entity_id", "r.related_id", F.col("r.entity_name").alias("related_name"), F.explode_outer("r.records").alias("k"))
    return each.select("entity_id", "related_id", "related_name", "k.data_source", "k.record_id")


def snapshot_relations(snapshots: DataFrame) -> DataFrame:
    """(entity_id, related_id, match_type, match_key, errule_code), directed: of a repeated related id the last counts.
    Relations of an entity with itself are left to :func:`self_relations`."""
    each = snapshots.select("entity_id", F.posexplode("related").alias("at", "r")).select("entity_id", "at", "r.related_id", "r.match_type", "r.match_key", "r.errule_code")
    last = F.row_number().over(W.partitionBy("entity_id", "related_id").orderBy(F.col("at").desc()))
    return each.where("entity_id <> related_id").withColumn("n", last).where("n = 1").drop("n", "at")


def self_relations(snapshots: DataFrame) -> DataFrame:
    """Snapshots that name themselves as related: an error in the feed."""
    return snapshots.where(F.exists("related", lambda r: r["related_id"] == F.col("entity_id")))


def missing_keys(snapshots: DataFrame) -> DataFrame:
    """Snapshots to be read again: a relation lacks its match key."""
    return snapshots.where(F.exists("related", lambda r: r["match_key"].isNull()))


def source_summary(records: DataFrame) -> DataFrame:
    """(entity_id, data_source, records): records of each source in each entity."""
    return records.groupBy("entity_id", "data_source").agg(F.count("*").alias("records"))


def to_json(records: DataFrame, relations: DataFrame, names: DataFrame, engine: bool = True) -> DataFrame:
    """(entity_id, body): snapshots in either dialect from flat records, directed relations and names (entity_id, entity_name)."""
    grouped = records.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("data_source", "record_id", "match_key", "errule_code"))).alias("rs"))
    grouped = grouped.join(names, "entity_id", "left")
    theirs = grouped.select(F.col("entity_id").alias("related_id"), F.col("rs").alias("theirs"), F.col("entity_name").alias("name"))
    links = relations.join(theirs, "related_id", "left").groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("related_id", "match_type", "match_key", "errule_code", "theirs", "name"))).alias("ls"))
    rows = grouped.join(links, "entity_id", "left")
    if engine:
        flag = lambda l, t: (l["match_type"] == t).cast("int")
        level = lambda l: F.when(l["match_type"].isin("AMBIGUOUS_MATCH", "POSSIBLE_MATCH"), "POSSIBLY_SAME").when(l["match_type"] == "DISCLOSED_RELATION", "DISCLOSED").otherwise("POSSIBLY_RELATED")
        record = lambda r: F.struct(r["data_source"].alias("DATA_SOURCE"), r["record_id"].alias("RECORD_ID"), r["match_key"].alias("MATCH_KEY"), r["errule_code"].alias("ERRULE_CODE"))
        key = lambda r: F.struct(r["data_source"].alias("DATA_SOURCE"), r["record_id"].alias("RECORD_ID"))
        link = lambda l: F.struct(
            l["related_id"].alias("ENTITY_ID"), l["name"].alias("ENTITY_NAME"), F.transform(l["theirs"], key).alias("RECORDS"), flag(l, "AMBIGUOUS_MATCH").alias("IS_AMBIGUOUS"),
            flag(l, "DISCLOSED_RELATION").alias("IS_DISCLOSED"), level(l).alias("MATCH_LEVEL_CODE"), l["match_key"].alias("MATCH_KEY"), l["errule_code"].alias("ERRULE_CODE"),
        )
        entity = F.struct(F.col("entity_id").alias("ENTITY_ID"), F.col("entity_name").alias("ENTITY_NAME"), F.transform("rs", record).alias("RECORDS"))
        return rows.select("entity_id", F.to_json(F.struct(entity.alias("RESOLVED_ENTITY"), F.transform("ls", link).alias("RELATED_ENTITIES"))).alias("body"))
    record = lambda r: F.struct(r["data_source"].alias("src"), r["record_id"].alias("id"), r["match_key"].alias("mkey"), r["errule_code"].alias("rule"))
    key = lambda r: F.struct(r["data_source"].alias("src"), r["record_id"].alias("id"))
    link = lambda l: F.struct(
        l["related_id"].alias("id"), l["name"].alias("name"), F.transform(l["theirs"], key).alias("records"), l["match_type"].alias("matchType"), l["match_key"].alias("matchKey"), l["errule_code"].alias("principle")
    )
    return rows.select("entity_id", F.to_json(F.struct(F.col("entity_id").alias("id"), F.col("entity_name").alias("name"), F.transform("rs", record).alias("records"), F.transform("ls", link).alias("related"))).alias("body"))

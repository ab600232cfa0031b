"""Message feed: bodies with one message or an array of messages, in two spellings, to flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import normalise_blank, trimmed

_SAMPLE = "ARRAY<STRUCT<FLAGS: ARRAY<STRING>, DATA_SOURCE: STRING, RECORD_ID: STRING, flags_: ARRAY<STRING>, dataSource: STRING, recordId: STRING>>"
_NOTICE = "ARRAY<STRUCT<CODE: STRING, DESCRIPTION: STRING>>"
#: Lists that a message may hold; one that is there but of another type is a broken message.
LISTS = ("AFFECTED_ENTITIES", "affectedEntities", "INTERESTING_ENTITIES", "interestingEntities", "NOTICES")
#: Both spellings; ids are read as text, so that one of a wrong type can be told from a missing one. The reader matches names without regard to case, so only names that differ otherwise appear twice.
MESSAGE = f"""ARRAY<STRUCT<DATA_SOURCE: STRING, RECORD_ID: STRING, AFFECTED_ENTITIES: ARRAY<STRUCT<ENTITY_ID: STRING>>,
INTERESTING_ENTITIES: STRUCT<ENTITIES: ARRAY<STRUCT<ENTITY_ID: BIGINT, DEGREES: INT, FLAGS: ARRAY<STRING>, SAMPLE_RECORDS: {_SAMPLE.replace('flags_: ARRAY<STRING>, ', '')}>>, NOTICES: {_NOTICE}>,
NOTICES: {_NOTICE}, dataSource: STRING, recordId: STRING, affectedEntities: ARRAY<STRUCT<entityId: STRING>>,
interestingEntities: ARRAY<STRUCT<entityId: BIGINT, degrees: INT, flags: ARRAY<STRING>, sampleRecords: ARRAY<STRUCT<dataSource: STRING, recordId: STRING, flags: ARRAY<STRING>>>>>>>"""


def _parsed(body: Column) -> Column:
    text = trimmed(body)
    return F.when(text != "", F.from_json(text, MESSAGE))


def _broken(body: Column, parsed: Column) -> Column:
    """Whether a message of a body has a list of another type, or an affected id that is no number: part of it is lost."""
    text = trimmed(body)
    raw = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "ARRAY<MAP<STRING, STRING>>")).otherwise(F.array(F.from_json(text, "MAP<STRING, STRING>")))
    both = F.arrays_zip(raw.alias("raw"), parsed.alias("m"))

    def lacks(z: Column) -> Column:
        return reduce(Column.__or__, [z["raw"][n].isNotNull() & z["m"][n].isNull() for n in LISTS])

    lost = F.exists(both, lacks)
    ids = lambda m: F.coalesce(m["AFFECTED_ENTITIES"]["ENTITY_ID"], m["affectedEntities"]["entityId"])
    wrong = F.exists(parsed, lambda m: F.exists(ids(m), lambda i: i.try_cast("long").isNull()))
    return F.coalesce(lost, F.lit(False)) | F.coalesce(wrong, F.lit(False))


def read_messages(feed: DataFrame, body: str = "body") -> DataFrame:
    """One row for each message of ``feed``, with the columns of the feed, ``number`` (within its body) and ``message``.

    Empty and null bodies hold no message; bodies that do not parse are left to :func:`dead_letters`. Of a message that parses in
    part, what does parse counts, and its body is a dead letter too.
    """
    rows = feed.withColumn("_all", _parsed(F.col(body)))
    rows = rows.select(*feed.columns, F.posexplode("_all").alias("number", "_m")).where("_m IS NOT NULL")
    m = F.col("_m")
    affected = F.transform(F.coalesce(m["AFFECTED_ENTITIES"]["ENTITY_ID"], m["affectedEntities"]["entityId"]), lambda i: i.try_cast("long"))
    sample = lambda s, a, b: F.transform(s, lambda r: F.struct(r[a].alias("data_source"), r[b].alias("record_id"), r["flags"].alias("flags")))
    upper = F.transform(
        m["INTERESTING_ENTITIES"]["ENTITIES"],
        lambda e: F.struct(e["ENTITY_ID"].alias("entity_id"), e["DEGREES"].alias("degrees"), e["FLAGS"].alias("flags"), sample(e["SAMPLE_RECORDS"], "DATA_SOURCE", "RECORD_ID").alias("samples")),
    )
    camel = F.transform(
        m["interestingEntities"],
        lambda e: F.struct(e["entityId"].alias("entity_id"), e["degrees"].alias("degrees"), e["flags"].alias("flags"), sample(e["sampleRecords"], "dataSource", "recordId").alias("samples")),
    )
    nothing = F.array().cast(_NOTICE)
    notices = F.concat(F.coalesce(m["INTERESTING_ENTITIES"]["NOTICES"], nothing), F.coalesce(m["NOTICES"], nothing))
    message = F.struct(
        F.coalesce(m["DATA_SOURCE"], m["dataSource"]).alias("data_source"), F.coalesce(m["RECORD_ID"], m["recordId"]).alias("record_id"),
        affected.alias("affected"), F.coalesce(upper, camel).alias("interesting"), notices.alias("notices"),
    )
    return rows.withColumn("message", message).drop("_m")


def dead_letters(feed: DataFrame, body: str = "body") -> DataFrame:
    """Rows of ``feed`` whose body is not empty and parses to nothing, or holds a message of which a part is lost."""
    parsed = _parsed(F.col(body))
    filled = F.regexp_replace(F.col(body), r"[\x00-\x20]+", "") != ""
    junk = parsed.isNull() | ((F.size(parsed) == 1) & F.get(parsed, F.lit(0)).isNull())
    return feed.where(filled & (junk | _broken(F.col(body), parsed)))


def affected_entities(messages: DataFrame) -> DataFrame:
    """One row for each affected entity of each message (a set: repeated ids count once)."""
    rest = [c for c in messages.columns if c != "message"]
    return messages.select(*rest, F.explode(F.array_distinct("message.affected")).alias("entity_id")).where("entity_id IS NOT NULL")


def touched_records(messages: DataFrame) -> DataFrame:
    """One row for each message that names a record: both parts not blank."""
    rest = [c for c in messages.columns if c != "message"]
    rows = messages.select(*rest, normalise_blank(F.col("message.data_source")).alias("data_source"), normalise_blank(F.col("message.record_id")).alias("record_id"))
    return rows.where("data_source IS NOT NULL AND record_id IS NOT NULL")


def interesting_entities(messages: DataFrame) -> DataFrame:
    """One row for each sample record of each interesting entity; entities without samples give one row with nulls."""
    rest = [c for c in messages.columns if c != "message"]
    rows = messages.select(*rest, F.explode("message.interesting").alias("e"))
    rows = rows.select(*rest, "e.entity_id", "e.degrees", F.array_join(F.array_sort(F.array_distinct("e.flags")), ",").alias("flags"), F.explode_outer("e.samples").alias("s"))
    return rows.select(*rest, "entity_id", "degrees", "flags", "s.data_source", "s.record_id", F.array_join(F.array_sort(F.array_distinct("s.flags")), ",").alias("sample_flags"))


def notices(messages: DataFrame) -> DataFrame:
    """One row for each notice, from inside the interesting entities and from the top level."""
    rest = [c for c in messages.columns if c != "message"]
    return messages.select(*rest, F.inline("message.notices")).withColumnsRenamed({"CODE": "code", "DESCRIPTION": "description"})


def message_multiplicity(affected: DataFrame) -> DataFrame:
    """(entity_id, multiplicity): requests for the same entity collapsed into one."""
    return affected.groupBy("entity_id").agg(F.count("*").alias("multiplicity"))

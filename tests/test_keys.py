import pytest
from pyspark.sql import functions as F

from tallymart.functions import keys as K

#: Match keys and what they are from the other side.
REVERSED = [
    (None, None),
    ("", ""),
    ("NAME+DOB", "NAME+DOB"),
    ("+REL_POINTER(:ABC)", "+REL_POINTER(ABC:)"),
    ("+REL_POINTER(EMPLOYER:EMPLOYEE)", "+REL_POINTER(EMPLOYEE:EMPLOYER)"),
    ("+REL_POINTER()", "+REL_POINTER()"),
    ("+REL_POINTER(ABC)", "+REL_POINTER(ABC)"),
    ("+REL_POINTER(A:B:C)", "+REL_POINTER(A:B:C)"),
    ("+REL_POINTER(ABC:", "+REL_POINTER(ABC:"),
    (r"+REL_POINTER(GLOBAL\:PARENT:SUBSIDIARY)", r"+REL_POINTER(SUBSIDIARY:GLOBAL\:PARENT)"),
    (r"+REL_POINTER(PATH\\TO\:VALUE:)", r"+REL_POINTER(:PATH\\TO\:VALUE)"),
    ("+NAME-DOB+REL_POINTER(EMPLOYER:EMPLOYEE)", "+NAME-DOB+REL_POINTER(EMPLOYEE:EMPLOYER)"),
    ("+REL_POINTER(A:B)+REL_POINTER(C:D)", "+REL_POINTER(B:A)+REL_POINTER(D:C)"),
    ("+SSN (Ambiguous)", "+SSN (Ambiguous)"),
    ("+REL_POINTER(HUSBAND:WIFE) (Ambiguous)", "+REL_POINTER(WIFE:HUSBAND) (Ambiguous)"),
    ("  +REL_POINTER(A:B)  ", "+REL_POINTER(B:A)"),
    ("(A:B)", "(A:B)"),
]


def test_reversal(spark):
    rows = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(REVERSED)], "i int, k string")
    got = [r.r for r in rows.select("i", K.reverse_match_key(F.col("k")).alias("r")).orderBy("i").collect()]
    assert got == [r for _, r in REVERSED]


def test_statistics(spark):
    cases = [("S", None, None, "S"), ("S", None, "P", "S:P"), ("S", "K", None, "S::K"), ("S", "K:x", "P", "S:P:K:x")]
    rows = spark.createDataFrame(cases, "s string, k string, p string, text string")
    out = rows.select("*", K.format_statistic(F.col("s"), F.col("k"), F.col("p")).alias("made"), K.parse_statistic(F.col("text")).alias("got")).collect()
    for r in out:
        assert r.made == r.text and (r.got.statistic, r.got.match_key, r.got.principle) == (r.s, r.k, r.p)


def test_report_keys(spark):
    cases = [("ESB", "3", None, None, "ESB:3"), ("DSS", "A:b c", "X Y", "X Y", "DSS:A%3Ab+c:X+Y:X+Y"), ("CSS", "S", "A*~", None, "CSS:S:A*%7E")]
    rows = spark.createDataFrame(cases, "r string, s string, a string, b string, key string")
    for r in rows.select("*", K.encode_report_key(*map(F.col, "rsab")).alias("made"), K.decode_report_key(F.col("key")).alias("got")).collect():
        assert r.made == r.key and tuple(r.got) == (r.r, r.s, r.a, r.b)
    for bad in ("ESB", "a:b:c:d:e"):
        with pytest.raises(Exception, match="malformed report key"):
            spark.createDataFrame([(bad,)], "key string").select(K.decode_report_key(F.col("key")).alias("got")).collect()
    with pytest.raises(Exception, match="second data source"):
        spark.createDataFrame([("DSS", "S", None, "B")], "r string, s string, a string, b string").select(K.encode_report_key(*map(F.col, "rsab"))).collect()


def test_classes_and_blanks(spark):
    rows = spark.createDataFrame([(1, 1, "X"), (0, 1, "POSSIBLY_SAME"), (None, None, "POSSIBLY_SAME"), (0, 0, "NAME_ONLY")], "a int, d int, c string")
    assert [r[0] for r in rows.select(K.classify_match(*map(F.col, "adc"))).collect()] == ["AMBIGUOUS_MATCH", "DISCLOSED_RELATION", "POSSIBLE_MATCH", "POSSIBLE_RELATION"]
    rows = spark.createDataFrame([(" a b\t",), ("\n \x00",), (None,)], "t string")
    assert [r[0] for r in rows.select(K.normalise_blank(F.col("t"))).collect()] == ["a b", None, None]


def test_orientation(spark):
    rows = spark.createDataFrame([(5, 2, "DISCLOSED_RELATION", "+R(A:B)", None), (1, 9, "DISCLOSED_RELATION", "+R(A:B)", None), (9, 3, "POSSIBLE_MATCH", "+R(A:B)", "X")], "entity_id long, related_id long, match_type string, match_key string, errule_code string")
    got = {(r.entity_id, r.related_id): (r.match_key, r.rev_match_key) for r in K.orient_relations(rows).collect()}
    assert got == {(2, 5): ("+R(B:A)", "+R(A:B)"), (1, 9): ("+R(A:B)", "+R(B:A)"), (3, 9): ("+R(A:B)", "+R(A:B)")}

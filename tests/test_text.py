"""Text rules on the cases that tell them apart."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text

LIMIT = " LIMIT 1000"
FORBIDDEN, NOT_READ = text.REASON_FORBIDDEN, text.REASON_NOT_READ

AUDIT = [
    ("SELECT 1", True, "SELECT 1" + LIMIT),
    ("select 1;", True, "select 1" + LIMIT),
    ("SELECT 1;;  ", True, "SELECT 1;;" + LIMIT),
    ("SELECT 1 ;", True, "SELECT 1" + LIMIT),
    ("  \n WITH x AS (SELECT 1) SELECT * FROM x", True, "  \n WITH x AS (SELECT 1) SELECT * FROM x" + LIMIT),
    ("SELECT credit_limit FROM t", True, "SELECT credit_limit FROM t"),
    ("SELECT * FROM (SELECT 1 LIMIT 3)", True, "SELECT * FROM (SELECT 1 LIMIT 3)"),
    ("SELECT updated_at FROM t", True, "SELECT updated_at FROM t" + LIMIT),
    ("SELECT a FROM t -- note", True, "SELECT a FROM t -- note" + LIMIT),
    ("SHOW TABLES", True, "SHOW TABLES"),
    ("DESC t", True, "DESC t"),
    ("explain select 1", True, "explain select 1"),
    ("SELECT 'drop it'", False, FORBIDDEN),
    ("SELECT replace(a, 'x', 'y') FROM t", False, FORBIDDEN),
    ("-- delete later\nSELECT 1", False, FORBIDDEN),
    ("insert into t select 1", False, FORBIDDEN),
    ("-- note\nSELECT 1", False, NOT_READ),
    ("(SELECT 1)", False, NOT_READ),
    ("SELECTED", False, NOT_READ),
    ("", False, NOT_READ),
    (None, False, NOT_READ),
    ("SELECT 1\n;\n", True, "SELECT 1\n;" + LIMIT),
]


@pytest.fixture(scope="module")
def audited(spark):
    rows = spark.createDataFrame([(i, a[0]) for i, a in enumerate(AUDIT)], "i int, sql string")
    return {r["i"]: r for r in text.sql_audit(rows).collect()}


@pytest.mark.parametrize("i", range(len(AUDIT)))
def test_audit(audited, i):
    _, ok, payload = AUDIT[i]
    row = audited[i]
    assert (row["ok"], row["cleaned"] if ok else row["reason"]) == (ok, payload)


@pytest.mark.parametrize("sql, ok, cleaned", [
    ("SELECT 'drop it' AS a", True, "SELECT 'drop it' AS a\nLIMIT 1000"),
    ("-- delete later\nSELECT 1; ", True, "-- delete later\nSELECT 1\nLIMIT 1000"),
    ("(SELECT credit_limit FROM t)", True, "(SELECT credit_limit FROM t)\nLIMIT 1000"),
    ("SELECT 1 LIMIT 5", True, "SELECT 1 LIMIT 5"),
    ("SELECT 1; DROP TABLE t", False, None),
])
def test_strict_audit(spark, sql, ok, cleaned):
    row = text.sql_audit(spark.createDataFrame([(sql,)], "sql string"), strict=True).first()
    assert (row["ok"], row["cleaned"]) == (ok, cleaned)


SALVAGE = [
    ('{"a": 1}', "whole", {"a": 1}),
    ('```json\n{"a": 1}\n```', "whole", {"a": 1}),
    ('```\n[1, 2]\n```  ', "whole", [1, 2]),
    ('Sure: {"a": {"b": 2}} done', "object", {"a": {"b": 2}}),
    ("take [1, 2, 3] please", "array", [1, 2, 3]),
    ("broken {", None, None),
    ("{} and }", None, None),
    ('{"a":1} {"b":2}', None, None),
    ("} {", None, None),
    ("{}, {}", None, None),
    ("{}] [{}", None, None),
    ('{"x": 1}} extra {"y": 1}', None, None),
    ("text [1] and {broken", "array", [1]),
    ("42", "whole", 42),
    ("", None, None),
    (None, None, None),
    ('  {"é": "ü"}\n', "whole", {"é": "ü"}),
    ('{"a": "]"}', "whole", {"a": "]"}),
]


def test_salvage(spark):
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SALVAGE)], "i int, t string")
    found = text.salvage_json(rows, "t").withColumn("json", F.to_json("json")).collect()
    for r in found:
        raw, how, value = SALVAGE[r["i"]]
        assert r["found"] == how, raw
        assert (None if r["json"] is None else json.loads(r["json"])) == value, raw
        assert (r["error"] is None) == (how is not None or raw is None), raw


def test_elide_boundary(spark):
    rows = spark.createDataFrame([("x" * 30000,), ("a" * 15000 + "b" + "c" * 15000,)], "t string")
    short, long = (r[0] for r in rows.select(text.elide("t")).collect())
    assert short == "x" * 30000
    assert long == "a" * 15000 + text.ELIDE_MARK + "c" * 15000


def test_explode_ids(spark):
    rows = spark.createDataFrame([(1, " a.b, c;d.e.f\n\tg ,;"), (2, ""), (3, None)], "i int, ids string")
    found = text.explode_ids(rows, "ids").orderBy("position").collect()
    assert [(r["table_id"], r["short_name"]) for r in found] == [("a.b", "b"), ("c", "c"), ("d.e.f", "f"), ("g", "g")]


def test_long_texts_do_not_overflow_the_engine(spark):
    long = [
        "SELECT '" + "x" * 100_000 + "' AS a", "SELECT a /* " + "y" * 100_000 + " */ FROM t", "SELECT a -- " + "z" * 100_000,
        "(" * 100_000 + "SELECT 1", "SELECT 1" + " ;" * 50_000, "SELECT 1" + " " * 100_000 + "x", 'SELECT "' + "q" * 100_000 + '"',
    ]
    from plumbline.functions.text import explode_ids, sql_audit

    audited = sql_audit(spark.createDataFrame([(t,) for t in long], "sql string"), strict=True)
    assert {r.ok for r in audited.collect()} == {True}
    ids = explode_ids(spark.createDataFrame([("a.b" + " " * 100_000 + "c.d",)], "ids string"), "ids").collect()
    assert [(r.position, r.table_id, r.short_name) for r in ids] == [(0, "a.b", "b"), (1, "c.d", "d")]

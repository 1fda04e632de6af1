"""Splitting of packed fields: quoting, lists, empty places, repeats, sizes."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auricle.operators import packed


def split(spark, values, keep=True):
    df = spark.createDataFrame([("t", str(i), v, "clash") for i, v in enumerate(values)], "src_table string, rec_key string, value string, item string")
    out: dict[int, list] = {}
    for r in packed.unpack(df, keep).orderBy("rec_key", "pos").collect():
        out.setdefault(int(r["rec_key"]), []).append((r["pos"], r["item"]))
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [i for _, i in v] for k, v in out.items()}


def test_forms(spark):
    values = [
        "calm", "a, b", "a ;b;", "x / /y", 'late night|"a; b"| c', '["a", "b c"]', "['a', 'x, y']", "[a, b]", None, "", "  ", "[]", ";;", 'r&b, "rock ""n"" reel"',
        '["so \\"x\\"", "\\u00e9"]', "warm & woolly\trock 'n' roll", "dub · dub", '"open, b', "a" * 20000 + ", b", '["a"]', "it's, ok",
    ]
    got = split(spark, values)
    assert got == {
        0: ["calm"], 1: ["a", "b"], 2: ["a", "b"], 3: ["x", "y"], 4: ["late night", "a; b", "c"], 5: ["a", "b c"], 6: ["a", "x, y"], 7: ["a", "b"],
        13: ["r&b", 'rock "n" reel'], 14: ['so "x"', "é"], 15: ["warm & woolly", "rock 'n' roll"], 16: ["dub", "dub"], 17: ['"open', "b"], 18: ["a" * 20000, "b"],
        19: ["a"], 20: ["it's", "ok"],
    }
    assert set(split(spark, values, keep=False)) == {k for k, v in got.items() if len(v) > 1}


def test_empty_table(spark):
    assert split(spark, [None]) == {}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.text("ab ,;/|'é&", min_size=1, max_size=6).filter(lambda s: s.strip()), min_size=1, max_size=4), min_size=20, max_size=40))
def test_json_round_trip(spark, lists):
    got = split(spark, [json.dumps(x, ensure_ascii=False) for x in lists])
    assert [got[i] for i in range(len(lists))] == [[v.strip() for v in x] for x in lists]


def test_rules_beyond_the_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(packed, "BROADCAST_RULES", 1)
    assert split(spark, ["a,b", "c;d;e"]) == {0: ["a", "b"], 1: ["c", "d", "e"]}
    df = spark.range(1).select(F.lit("t").alias("src_table"), F.lit("k").alias("rec_key"), F.lit("x|y").alias("value"))
    assert "BroadcastHashJoin" not in packed.unpack(df)._jdf.queryExecution().executedPlan().toString().split("+- Project")[0]

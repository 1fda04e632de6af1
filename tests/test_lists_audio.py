"""Lists of items, form parameters, and measures of synthetic signals."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from auricle.functions import audio
from auricle.operators import lists


def test_lists(spark):
    m = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "list_id long, item_id long, position long")
    every = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1)), (2, "a", dt.date(2021, 1, 1)), (3, "1", dt.date(2022, 1, 1))], "list_id long, name string, created_at date")
    assert [r["members"] for r in lists.overview(every, m).orderBy("list_id").collect()] == [2, 1, 0]
    assert [lists.resolve_list(every, w).collect() for w in ("zz",)] == [[]]
    assert [lists.resolve_list(every, w).first()["list_id"] for w in ("a", "1", "3")] == [2, 1, 3]
    new = spark.createDataFrame([(1, 11), (1, 12), (1, 12), (4, 9)], "list_id long, item_id long")
    assert {tuple(r) for r in lists.append(m, new).collect()} == {(1, 10, 1), (1, 11, 2), (2, 10, 1), (1, 12, 3), (4, 9, 1)}
    assert {tuple(r) for r in lists.clone(m, 1, 7).collect()} == {(7, 10, 1), (7, 11, 2)}
    assert [t.count() for t in lists.delete_lists(every.where("list_id = 1"), every, m)] == [2, 1]
    songs = spark.createDataFrame([(10, "s"), (11, "s")], "item_id long, song_id string")
    none = spark.createDataFrame([], "item_id long")
    assert {(r["list_id"], r["song_id"], r["position"]) for r in lists.sync_plan(m, songs, none).collect()} == {(1, "s", 1), (2, "s", 1)}


def test_outside_and_keys(spark):
    df = spark.createDataFrame([("D:\\A\\B\\x",), ("D:\\A\\Bc\\x",), (None,), ("",)], "p string")
    assert [r["p"] for r in lists.outside(df, "p", ["d:/a/b"]).collect()] == ["D:\\A\\Bc\\x", None, ""]
    k = df.limit(1).select(lists.cache_key("track", F.lit("track:a:b:c")).alias("k")).first()["k"]
    assert tuple(k) == ("a:b", "c")


def test_form():
    got = lists.form_params({"tier": "niche", "energy_min": 20, "include_moods": ["x"], "exclude_moods": ["x", "y"], "genres": ["unknown", "dub"], "bpm_max": None})
    assert got == {"energy_min": 0.2, "min_popularity": 0, "include_moods": ["x"], "exclude_moods": ["y"], "genres": ["dub"]}


def test_measures(spark):
    t = np.arange(256) / 256
    tone = np.sin(2 * np.pi * 32 * t)
    centroid, _, rolloff, flatness, zcr, rms, peak = audio.measures(tone, 256)
    assert abs(centroid - 32) < 1 and abs(rolloff - 32) < 1 and flatness < 0.1 and abs(rms - 0.707) < 0.01 and peak <= 1 and 0.2 < zcr < 0.3
    df = spark.createDataFrame([(1, tone.tolist()), (2, [0.5]), (3, None)], "i int, v array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", audio.spectrum(256.0)(F.col("v")).alias("s")).collect()}
    assert abs(got[1]["centroid"] - centroid) < 1e-9 and got[2]["centroid"] is None
    chroma = [audio.MINOR[(i - 9) % 12] for i in range(12)]
    k = spark.range(1).select(audio.key_of(F.array(*[F.lit(float(x)) for x in chroma])).alias("k")).first()["k"]
    assert (k["key"], k["mode"]) == ("A", "minor") and k["score"] > 0.99
    parts = df.where("i = 1").select(audio.chunks(F.col("v"), 100).alias("c")).first()["c"]
    assert [len(p) for p in parts] == [100, 100]


def test_classify(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [0.0]), ("c", [])], "k string, v array<double>")
    good = {r["k"]: r["label"] for r in audio.classify(df, "k", "v", lambda: lambda x: ("dub", float(x[0]))).collect()}
    assert good == {"a": "dub", "b": "unknown", "c": "unknown"}

    def missing():
        raise OSError

    assert {r["label"] for r in audio.classify(df, "k", "v", missing).collect()} == {"unknown"}

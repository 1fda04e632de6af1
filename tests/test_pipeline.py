"""Stages, adapters, caches and streams."""

import datetime as dt

from pyspark.sql import functions as F

from auricle.operators import pipeline as p
from auricle.streaming import jobs as st


def make_client():
    def client(row):
        if row["v"] == "bad":
            raise ValueError("no")
        return row["v"].upper()

    return client


def test_adapter_and_cache(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "metadata_id string, v string").coalesce(1)
    got = {r["metadata_id"]: (r["success"], r["data"], r["error"]) for r in p.call_adapter(rows, "metadata_id", make_client, 1000).collect()}
    assert got == {"a": (True, "X", None), "b": (False, None, "ValueError: no"), "c": (True, "Y", None)}
    cache = spark.createDataFrame([("a", "old")], "metadata_id string, data string")
    every, after = p.through_cache(rows, "metadata_id", cache, lambda miss: miss.select("metadata_id", F.upper("v").alias("data")))
    assert {tuple(r) for r in every.collect()} == {("a", "old"), ("b", "BAD"), ("c", "Y")} == {tuple(r) for r in after.collect()}


def test_limiter():
    slept, now = [], [0.0]
    lim = p.Limiter(2, lambda: now[0], slept.append)
    for _ in range(3):
        lim.wait()
    assert slept == [0.5, 1.0]


def test_stages_and_enrich(spark):
    df = spark.createDataFrame([("a", "", None), ("b", "B", "1999")], "metadata_id string, album string, year string")
    seen = []
    reg = {s: (lambda d, s=s: seen.append(s) or d) for s in p.STAGES}
    p.run_stages(df, reg)
    assert seen == [s for s in p.STAGES if s != "ml_classify"]
    lfm = spark.createDataFrame([("a", "L")], "metadata_id string, album string")
    rec = spark.createDataFrame([("a", "R", "2001-02"), ("b", "R", "x")], "metadata_id string, album string, date string")
    assert {tuple(r) for r in p.enrich(df, lfm, rec).collect()} == {("a", "L", "2001"), ("b", "B", "1999")}
    auto = spark.createDataFrame([("1", "a", "fuzzy"), ("2", "b", "exact")], "id string, metadata_id string, confidence string")
    over = spark.createDataFrame([("1", None)], "id string, metadata_id string")
    assert {tuple(r) for r in p.import_overrides(auto, over).collect()} == {("1", None, "none"), ("2", "b", "exact")}


def test_scans(spark):
    side = spark.createDataFrame([("a", "/n", "h"), ("b", "/b", "h"), ("z", "/z", "h"), ("c", "/n2", "x")], "metadata_id string, path string, hash_partial string")
    tracks = spark.createDataFrame([("a", "/o", "h"), ("b", "/b", "h"), ("c", "/c", "h")], "metadata_id string, full_path string, hash_partial string")
    got = {r["metadata_id"]: r["status"] for r in p.relocation_status(side, tracks).collect()}
    assert got == {"a": "update", "b": "unchanged", "z": "orphan", "c": "hash_mismatch"}
    assert [d.count() for d in p.triage(side, tracks)] == [1, 3]


def test_resumable_ingest(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(3).withColumn("v", F.lit("a")).write.parquet(src)
    schema = "id long, v string"
    st.drain(st.landing(spark, src, schema), st.append_new(["id"], out), ck)
    spark.range(1, 5).withColumn("v", F.lit("b")).write.mode("append").parquet(src)
    st.drain(st.landing(spark, src, schema), st.append_new(["id"], out), ck)
    st.drain(st.landing(spark, src, schema), st.append_new(["id"], out), str(tmp_path / "ck2"))
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b")]


def test_windows_equal_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "click", 1.0) for m in (0, 1, 6, 7, 40)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = st.windowed_counts(st.landing(spark, str(tmp_path / "e"), "ts timestamp, event_type string, value double"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    batch = st.windowed_counts(spark.read.parquet(str(tmp_path / "e")))
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in batch.collect()}


def test_job_states(spark, tmp_path):
    rows = [("a", 1, "running"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 1, "done")]
    spark.createDataFrame(rows, "id string, seq int, status string").coalesce(1).write.parquet(str(tmp_path / "j"))
    stream = st.job_states(st.landing(spark, str(tmp_path / "j"), "id string, seq int, status string"))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").trigger(once=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} >= {("a", "failed", 2), ("b", "done", 0)}

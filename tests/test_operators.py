"""Merges, job states, resolving and sources."""

import datetime as dt

from pyspark.sql import functions as F

from auricle.functions import features, text
from auricle.operators import merge, resolve
from auricle.sources import records, sinks

OLD = [("a", "x", None), ("b", "", "2"), ("c", None, "3")]


def frame(spark, rows, schema="k string, v string, w string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_modes(spark):
    old, new = frame(spark, OLD), frame(spark, [("b", "n", None), ("d", "m", None)])
    assert rows(merge.insert_ignore(old, new, ["k"], [F.col("v")])) == rows(frame(spark, [*OLD, ("d", "m", None)]))
    assert ("b", "n", None) in rows(merge.replace_rows(old, new.select("k", "v"), ["k"]))
    assert ("b", "n", "2") in rows(merge.upsert(old, new, ["k"], ["v"]))
    assert ("b", "n", "2") in rows(merge.fill_if_empty(old, new, ["k"], ["v"]))
    assert ("a", "x", None) in rows(merge.fill_if_empty(old, frame(spark, [("a", "z", "z")]), ["k"], ["v"]))
    assert [r[0] for r in rows(merge.delete_keys(old, new, ["k"]))] == ["a", "c"]


def test_positions(spark):
    df = spark.createDataFrame([("p", c, i + 1) for i, c in enumerate("abcde")], "list_id string, item string, position int")
    order = lambda d: "".join(r["item"] for r in d.orderBy("position").collect())
    assert order(merge.move_to(df, "list_id", "position", 2, 4)) == "acdbe"
    assert order(merge.move_to(df, "list_id", "position", 4, -3)) == "dabce"
    assert order(merge.move_to(df, "list_id", "position", 9, 1)) == "abcde"
    assert order(merge.swap_up(df, "list_id", "position", 3)) == "acbde"
    assert order(merge.swap_up(df, "list_id", "position", 1)) == "abcde"


def test_jobs(spark):
    now = dt.datetime(2024, 1, 1, 12)
    log = spark.createDataFrame([(1, "s", 1, "pending"), (1, "s", 2, "failed"), (2, "s", 1, "running")], "id long, stage string, seq int, status string")
    assert rows(merge.latest_state(log, ["id"], "seq").select("id", "status")) == [(1, "failed"), (2, "running")]
    jobs = spark.createDataFrame([(1, "s", "failed", 2, None), (2, "s", "running", 0, now - dt.timedelta(hours=2)), (3, "s", "running", 0, now)], "id long, stage string, status string, attempts int, claimed_at timestamp")
    assert rows(merge.retry_failed(jobs, "s", 3).select("status"))[1:] == [("running",), ("running",)]
    assert rows(merge.expire_leases(jobs, F.lit(now), 3600).select("id", "status")) == [(1, "failed"), (2, "pending"), (3, "running")]


def test_names_and_titles(spark):
    names = {
        "D:\\x\\01 - Act - Song.mp3": ("", "Act - Song"), "[03] Act - Song (Live).flac": ("Act", "Song (Live)"), "2 Damn - Go.ogg": ("2 Damn", "Go"),
        "12 - Act - Song.mp3": ("Act", "Song"), "Lone (unknown artist).mp3": ("", "Lone"), "": ("", ""),
    }
    names["D:\\x\\01 - Act - Song.mp3"] = ("Act", "Song")
    df = frame(spark, [(n, None, None) for n in names])
    got = {r["k"]: (r["p"]["artist"], r["p"]["title"]) for r in df.select("k", text.filename_parts(F.col("k")).alias("p")).collect()}
    assert got == names
    titles = {"Flow (Rave Mix)": "Flow", "Song - DJ Name Remix": "Song", "Just A Title": "Just A Title", "Levels (Radio Edit)": "Levels", "": ""}
    df = frame(spark, [(n, None, None) for n in titles])
    assert {r["k"]: r["b"] for r in df.select("k", text.base_title(F.col("k")).alias("b")).collect()} == titles
    keys = frame(spark, [("The Café & Co", "Live at X (2011 Remaster) - Radio Edit", None)]).select(text.artist_keys(F.col("k")).alias("a"), text.title_key(F.col("v")).alias("t")).first()
    assert keys["a"] == ["the cafe", "cafe"] and keys["t"] == "live at x"


def test_features(spark):
    r = spark.range(1).select(
        features.camelot(F.lit("A"), F.lit("minor")).alias("key"),
        features.bpm_bucket(F.lit(138)).alias("bpm"),
        features.popularity_tier(F.lit(5000)).alias("tier"),
        features.decade(F.lit("1999-01-02")).alias("decade"),
        features.decade(F.lit("abcd")).alias("none"),
        features.camelot_compatible(F.lit("12A"), F.lit("1A")).alias("wrap"),
        features.camelot_compatible(F.lit("8A"), F.lit("9B")).alias("no"),
        features.target_bitrate(F.lit("mp3"), F.lit(128)).alias("rate"),
        features.integrity_labels(F.lit("Header missing; CRC mismatch")).alias("labels"),
        features.correlation(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(4.0), F.lit(6.0))).alias("r"),
    ).first()
    assert (r["key"], r["bpm"], r["tier"], r["decade"], r["none"], r["wrap"], r["no"], r["rate"]) == ("8A", "fast", "mainstream", "1990s", None, True, False, 96)
    assert r["labels"] == ["missing_header", "crc_error"] and abs(r["r"] - 1) < 1e-9


def test_resolve(spark):
    songs = frame(spark, [("s1", "river", "the band"), ("s2", "river", "xx"), ("s3", "", "the band")], "song_id string, title_key string, artist_key string")
    want = frame(spark, [("t1", "river", "the bands"), ("t2", "none", "the band"), ("t3", "", "")], "id string, title_key string, artist_key string")
    assert [(r["id"], r["song_id"]) for r in resolve.best_fuzzy(want, songs).collect()] == [("t1", "s1")]


def test_resolve_without_block(spark, monkeypatch):
    """A title that no song has is compared with all songs; the best artist variant counts."""
    songs = [("s1", "river song", "the band"), ("s2", "river", "other act"), ("s3", "a" * 400, "band"), ("s4", "river songs", "bund")]
    rows = [("t1", "rivers song", ["band", "the band"]), ("t2", "river", ["the band"]), ("t3", "a" * 399 + "b", ["band"]), ("t4", "river sonf", ["band"]), ("t5", "river song", ["band", "the band"])]
    index, want = frame(spark, songs, "song_id string, title_key string, artist_key string"), frame(spark, rows, "id string, title_key string, artist_keys array<string>")
    ratio, best = resolve.ratio, {}
    for i, title, keys in rows:
        for sid, t, a in [s for s in songs if s[1] == title] or songs:
            x, y = ratio(title, t) * 100, max(ratio(k, a) for k in keys) * 100
            if x >= 70 and y >= 70:
                best[i] = max(best.get(i, (0, "")), (x * 0.6 + y * 0.4, sid))
    assert set(best) == {"t1", "t3", "t4", "t5"}
    for block in (4000, 2):
        monkeypatch.setattr(resolve, "BLOCK", block)
        got = {r["id"]: (round(r["score"], 6), r["song_id"]) for r in resolve.best_fuzzy(want, index).collect()}
        assert got == {i: (round(x, 6), sid) for i, (x, sid) in best.items()}


def test_sources(spark, tmp_path):
    probe = '{"streams":[{"codec_type":"video"},{"codec_type":"audio","codec_name":"mp3","bit_rate":"x","sample_rate":"44100","channels":2}],"format":{"bit_rate":"320000","duration":"1.5","tags":{"TITLE":"t"}}}'
    hits = '{"results":[{"id":"r","score":0.9,"recordings":[{"id":"m","title":"T","artists":[{"name":"A"}],"releases":[]},{"id":"n"}]},{"score":0.1}]}'
    df = frame(spark, [(probe, hits, "bad json")])
    p = df.select(records.probe_report(F.col("k")).alias("p")).first()["p"]
    assert (p["codec"], p["bitrate"], p["duration_ms"], p["tags"]) == ("mp3", 320000, 1500, {"title": "t"})
    assert [(r["recording_id"], r["artist"]) for r in records.fingerprint_hits(df, "w", "v").collect()] == [("m", "A"), ("n", None)]
    assert df.select(records.lastfm_track(F.col("w")).alias("x")).first()["x"]["listeners"] == 0
    lists = spark.createDataFrame([("p", 2, "", "B", None, "/b"), ("p", 1, "A", "T", 1999, "/a")], "list_id string, position int, artist string, title string, duration_ms long, full_path string")
    assert sinks.playlist_lines(lists, "list_id").first()["body"] == "#EXTM3U\n#EXTINF:1,A - T\n/a\n#EXTINF:-1,Unknown - B\n/b"
    sinks.write_export(lists, str(tmp_path / "out"), "csv")
    assert records.read_export(spark, str(tmp_path / "out"), ",").count() == 2

"""Sources, intake, enrichment and conversion on small cases: nulls, empty tables, ties and clashing columns."""

import pytest
from pyspark.sql import functions as F

from auricle.functions import audio, coerce, paths
from auricle.operators import conversion, enrichment, intake, playlist, prune, resolve
from auricle.sources import records, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_encodings_and_separators(spark, tmp_path):
    assert [records.encoding_of(x) for x in (b"plain", "é".encode(), "é".encode()[:1], "é;x".encode("latin-1") + b";", "hi".encode("utf-16"))] == ["utf-8", "utf-8", "utf-8", "latin-1", "utf-16"]
    (tmp_path / "a.csv").write_bytes("Title;Artist;\nÉ;x;\n".encode("latin-1"))
    assert records.sniff(spark, str(tmp_path / "a.csv")) == (";", "latin-1")
    (tmp_path / "b.csv").write_text('"Title","Artist"\n"a","b"\n')
    assert records.sniff(spark, str(tmp_path / "b.csv")) == (",", "utf-8")
    assert records.read_export(spark, str(tmp_path / "b.csv"), ",").first()["Artist"] == "b"


def test_scan_leaves_out_folders(spark, tmp_path):
    for name in ("a/x.mp3", "Skip/y.flac", "a/skip/z.opus", "a/note.txt", "Skipped/w.MP3"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"1")
    got = {r["path"].rsplit("/", 1)[1] for r in records.scan_files(spark, str(tmp_path), ("skip",)).collect()}
    assert got == {"x.mp3", "w.MP3"}


def test_tags(spark):
    df = frame(spark, [({"TIT2": " T ", "TRCK": "3/12", "TPE2": "", "ISRC": "X1", "TPUB": "L"}, {"TIT2": "T", "TBPM": " ", "ZZZ": "z"})], "t map<string,string>, f map<string,string>")
    r = df.select(records.file_tags(F.col("t")).alias("t"), records.frame_tags(F.col("f")).alias("f")).first()
    assert (r["t"]["title"], r["t"]["track_number"], r["t"]["total_tracks"], r["t"]["album_artist"], r["t"]["label"]) == ("T", "3", "12", None, "L")
    assert r["t"]["embedded_ids"] == {"embedded_isrc": "X1"} and r["f"] == {"title": "T"}


def test_service_track(spark):
    body = '{"tracks":{"items":[{"id":"1","name":"N","duration_ms":5,"album":{"name":"A","release_date":"1999-02"},"artists":[{"name":"X"},{"name":"Y"}]}]}}'
    r = frame(spark, [(body, "no json")], "a string, b string").select(records.service_track(F.col("a")).alias("a"), records.service_track(F.col("b")).alias("b")).first()
    assert (r["a"]["artist"], r["a"]["year"], r["b"]["track_id"]) == ("X, Y", "1999", None)


def test_byte_ranges(spark):
    heads = [None, "bytes=2-4", "bytes=7-", "bytes=-3", "bytes=20-30", "bytes=5-99", "x"]
    df = frame(spark, [(bytearray(b"0123456789"), h) for h in heads], "c binary, h string")
    got = [(r["s"]["status"], bytes(r["s"]["body"] or b"")) for r in df.select(sinks.byte_range(F.col("c"), F.col("h")).alias("s")).collect()]
    assert got == [(200, b"0123456789"), (206, b"234"), (206, b"789"), (206, b"789"), (416, b""), (206, b"56789"), (416, b"")]


def test_overflow_and_parameters(spark):
    r = frame(spark, [(["a", "b", "c", "d"], ["a"])], "x array<string>, y array<string>").select(intake.with_overflow(F.col("x"), 2).alias("x"), intake.with_overflow(F.col("y"), 2).alias("y")).first()
    assert (r["x"], r["y"]) == (["a", "b; c; d"], ["a"])
    assert coerce.comma_list(" a, ,b ") == ["a", "b"] and coerce.comma_list(None) == []
    assert coerce.key_values(["bpm=120", "mood= dark"]) == {"bpm": 120.0, "mood": "dark"}
    with pytest.raises(ValueError):
        coerce.key_values(["bpm"])


def test_common_parent(spark):
    rows = [(["/a/b/x.mp3", "/a/b/c/y.mp3"],), (["/a/b/x", "/z/y"],), (["C:\\m\\x", "C:\\m\\n\\y"],), ([],)]
    got = [r["p"] for r in frame(spark, rows, "x array<string>").select(paths.common_parent(F.col("x")).alias("p")).collect()]
    assert got == ["/a/b", "", "C:/m", ""]


def test_enrichment_of_nothing(spark):
    tracks = frame(spark, [("t", None, "", None)], "metadata_id string, album string, year string, length_seconds string")
    lastfm = frame(spark, [], "metadata_id string, duration_ms long, album string, tags array<struct<name:string,count:int>>")
    rec = frame(spark, [("t", None, None, ["", None], None, "20xx", "")], "metadata_id string, recording_id string, artist_id string, isrcs array<string>, tags array<string>, date string, album string")
    assert tuple(enrichment.fill_tracks(tracks, lastfm, rec).first()) == ("t", None, "", None)
    ids = frame(spark, [], "metadata_id string, source string, external_id string, confidence double")
    assert enrichment.merge_ids(ids, rec, rec.select("metadata_id", "artist_id")).count() == 0


def test_conversion_states_and_companions(spark):
    cases = [(None, 0, 0, 1, True), (5, 3, None, None, None), (5, 0, 1, 1, True), (5, 0, 0, None, True), (5, 0, 0, 0, True), (5, 0, 0, 9, False), (5, 0, 0, 9, True)]
    df = frame(spark, cases, "s long, t long, c int, r long, k boolean")
    got = [tuple(r["x"]) for r in df.select(conversion.state(*[F.col(x) for x in "stcrk"]).alias("x")).collect()]
    assert got == [("failed", "missing_source"), ("skipped_existing", None), ("failed", "encoder_failed"), ("failed", "missing_output"), ("failed", "empty_output"), ("failed", "finalize_failed"), ("converted", None)]
    files = frame(spark, [("/a/x.mp3",), ("/a/x.lrc",), ("/a/y.lrc",), (None,)], "path string")
    assert [tuple(r) for r in conversion.companions(files, records.AUDIO).collect()] == [("/a/x.mp3", "/a/x.lrc")]
    assert conversion.seen_paths(frame(spark, [("/a/Skip/x",), ("/a/skipper/x",)], "path string"), ["skip", ""]).count() == 1
    kept = conversion.sidecar_payloads(frame(spark, [("a", "/x"), ("b", "/y")], "metadata_id string, full_path string"), frame(spark, [("a", "old")], "metadata_id string, created_at string"), F.lit("now"))
    assert {r["metadata_id"]: ('"created_at":"old"' in r["payload"]) for r in kept.collect()} == {"a": True, "b": False}


def test_read_through_and_parts(spark):
    schema = "folder string, path string"
    live, none = frame(spark, [("f", "b"), ("f", "a")], schema), frame(spark, [], schema)
    assert [r["path"] for r in intake.read_through(none, live, "path").collect()] == ["a", "b"]
    old = frame(spark, [("f", "x"), ("g", "y")], schema)
    assert sorted(tuple(r) for r in intake.replace_part(old, live, ["folder"]).collect()) == [("f", "a"), ("f", "b"), ("g", "y")]
    scored = frame(spark, [(95.0, 50.0), (80.0, 90.0), (89.0, 84.0)], "title_score double, artist_score double")
    assert intake.sure_matches(scored).count() == 2


def test_axe_order(spark):
    listed = frame(spark, [("1", "review_fast", "r"), ("2", "safe_auto", "r"), ("3", "review_fast", "r")], "metadata_id string, tier string, reason string")
    tracks = frame(spark, [("1", "b", "t"), ("2", "z", "t"), ("3", "A", None)], "metadata_id string, artist string, title string")
    assert [r["metadata_id"] for r in prune.axe_order(listed, tracks).collect()] == ["2", "3", "1"]


def test_contained_against_brute_force(spark):
    texts = ["river in river (live)", "sun", "sunday", "a", "ab", "über der sonne", "%x_", "xx"]
    probes = ["river", "sun", "a", "un", "der s", "%", "zzz", "x"]
    got = {tuple(r) for r in resolve.contained(frame(spark, [(p,) for p in probes], "p string"), frame(spark, [(t,) for t in texts], "t string")).collect()}
    assert got == {(p, t) for p in probes for t in texts if p in t}


def test_tiers(spark):
    tracks = frame(spark, [("t1", "River", "Act"), ("t2", "River in River (Live)", "The Acts"), ("t3", "River", "Other"), ("t4", None, "Act"), ("t5", "", None)], "metadata_id string, title string, artist string")
    rows = frame(spark, [("a", "river", "act"), ("b", "in river", "act"), ("c", "river", "nobody"), ("d", "none", "act"), ("e", "", "act"), ("f", "river", None)], "id string, title string, artist string")
    got = {r["id"]: (r["metadata_id"], r["confidence"]) for r in resolve.tiered(rows, tracks).collect()}
    assert got == {"a": ("t1", "exact"), "b": ("t2", "fuzzy"), "c": ("t1", "fuzzy"), "f": ("t1", "fuzzy")}


def test_fuzzy_repeats(spark):
    """The count of the row-by-row loop."""
    rows = [("l", i, a, t) for i, (a, t) in enumerate([("x", "lonely satellite"), ("x", "lonely satellites"), ("x", "lonely satellite"), ("y", "lonely satellite"), ("x", "river"), ("x", "lonely satellitess"), ("x", "lonely satellites")])]
    kept, repeats = [], 0
    for _, _, a, t in rows:
        if (a, t) in kept or any(a == b and resolve.ratio(u, t) * 100 >= 85 for b, u in kept):
            repeats += 1
        else:
            kept.append((a, t))
    df = frame(spark, rows, "list_id string, at int, artist_key string, title_key string")
    assert resolve.fuzzy_repeats(df, "list_id", "at").first()["fuzzy_repeats"] == repeats


def test_chunks_and_timbre(spark):
    df = frame(spark, [([1.0, 3.0, 1.0, 3.0, 9.0],), ([2.0, 2.0],), ([],)], "v array<double>")
    got = [r["c"] for r in df.select(audio.chunks(F.col("v"), 2).alias("c")).collect()]
    flat = [x for c in got[0] for x in c]
    assert len(got[0]) == 2 and abs(flat[0] - (1 - 3.4) / 2.9393876) < 1e-6 and got[1] == [[0.0, 0.0]] and got[2] == []
    r = df.select(audio.timbre(8.0)(F.col("v")).alias("t")).collect()
    assert len(r[0]["t"]["mfcc"]) == 13 and r[2]["t"]["mfcc"] is None


def test_harmonic_reorder():
    rows = [("a", "1A", 100.0), ("b", "5B", 90.0), ("c", "9B", 104.0), ("d", "9B", 96.0)]
    assert playlist.harmonic(rows) == ["a", "c", "d", "b"] and playlist.harmonic(rows, reorder=True)[0] == "a"
    assert playlist.harmonic([]) == []


def test_key_of_nothing(spark):
    """No chroma has no key, and a null pitch class no note."""
    df = frame(spark, [(None, None), ([0.0] * 11 + [1.0], 11), ([1.0] + [0.0] * 11, 0)], "v array<double>, i int")
    got = [(r["k"]["key"], r["n"]) for r in df.select(audio.key_of(F.col("v")).alias("k"), audio.note_at(F.col("i")).alias("n")).collect()]
    assert got == [(None, None), ("B", "B"), ("C", "C")]

"""Names, matches and survivors against brute force and small cases."""

import itertools
import random

from auricle.llm import matching, names, survivors


def damerau(a, b):
    """Unrestricted distance, cell by cell."""
    last, inf = {}, len(a) + len(b)
    d = {(-1, -1): inf}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), col
            same = a[i - 1] == b[j - 1]
            col = j if same else col
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def words(n, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    return sorted(set(base))


def test_near():
    texts = words(60)
    for a, b in itertools.product(texts, texts):
        assert names.near(a, b) == (damerau(a, b) <= 1)


def test_distances_to_pivots():
    """A run of one letter is as far as its length less the number of that letter."""
    for t in words(40):
        for c in "abcdefx":
            assert damerau(t, c * 9) == 9 - t.count(c)


def test_radius_join(spark):
    texts = [*words(150, 2), "naïve", "naive", "näive", "白根", "白根沢", "根白", "x😀y", "x😀", "😀xy"]
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if damerau(a, b) <= 1}
    df = spark.createDataFrame([(t,) for t in texts * 2 + [""]], "core string")
    assert {tuple(r) for r in names.radius_join(df).collect()} == want
    assert names.radius_join(df.limit(0)).count() == 0


SPELLINGS = [
    ["Elisabeth Jebuhuton", "Jebuhuton, Elisabeth", "E. Jebuhuton", "ELISABETH JEBUHUTON", "Elisabeth  Jebuhuton", "Betty Jebuhuton", "Elisabeth “Liz” Jebuhuton", "Elisabeth M. Jebuhuton", "Elisabteh Jebuhuton"],
    ["The Nikadruric Brothers", "Nikadruric Bros.", "Nikadruric Brothers, The", "Nikadruric Brothers (The)"],
    ["The Nikadruric Trio", "Nikadruric 3o"],
    ["Bogadrushaw & The Foxes", "Bogadrushaw + The Foxes", "The Foxes & Bogadrushaw", "Bogadrushaw n the Foxes"],
    ["Charlotte Pazetuton", "Pazetuton Charlotte"],
    ["Xaver Pazetuton"],
    ["DJ Ravazuvez", "Deejay Ravazuvez", "Ravazuvez (DJ)", "D.J. Ravazuvez"],
    ["Николай Жанухуов", "Жанухуов, Н.", "Коля Жанухуов"],
    ["Young Fupeturic", "Youngfupeturic"],
]


def test_acts(spark):
    every = [(n, 3) for g in SPELLINGS for n in g]
    got = names.pairs_of(names.acts(spark.createDataFrame(every, "name string, n long")))
    want = {tuple(sorted(p)) for g in SPELLINGS for p in itertools.combinations(g, 2)}
    assert {tuple(r) for r in got.collect()} == want


def test_ambiguous_initial(spark):
    df = spark.createDataFrame([("Carl Pazetuton", 1), ("Clara Pazetuton", 1), ("C. Pazetuton", 1)], "name string, n long")
    assert names.acts(df).count() == 0


def test_links_against_brute_force(spark):
    """The keys lose no pair that the comparison accepts, also where a surname, a given name or a kind is common."""
    rng = random.Random(7)
    given = ["Elisabeth", "Betty", "Robert", "Bob", "Li", "Jo", "Wilhelmina", "Mina", "Xaver", "E.", "R.", "W. M."]
    last = ["Jebuhuton", "Jebuhutn", "Ng", "Kim", "Pazetuton", "Paz-Etuton", "Northern Bribra", "Nrothern Bribar"]
    people = [f"{rng.choice(given)} {rng.choice(last)}" for _ in range(120)] + [f"{rng.choice(last)}, {rng.choice(given)}" for _ in range(60)]
    bands = [f"{rng.choice(['The ', 'Teh ', ''])}{a} {b} {k}".strip() for a in ("Velvet", "Velvte", "Silver") for b in ("Harbour", "Harbor", "Bridge") for k in ("Quartet", "4tet", "Trio", "")]
    every = sorted({*people, *bands, "DJ Ravazu Kelp", "Deejay Ravzu Klep", "Ravazu & Kelpit", "Kelptit & Ravaz"})
    got = {frozenset(r[:2]) for r in names.link(spark.createDataFrame([(n, 1) for n in every], "name string, n long")).collect()}
    table = {(names.fold(n), names.fold(g)) for g, ns in names.NICKNAMES.items() for n in ns.split()}
    parsed = []
    for n in every:
        tokens, kind, _, joined = names.parse(n)
        parsed.append({"name": n, "tokens": tokens, "kind": kind, "joined": joined, "formal": [{"nick": a, "formal": b} for a, b in table if a in tokens]})
    alike = {}
    for x in parsed:
        alike.setdefault((tuple(sorted(x["tokens"])), x["kind"], x["joined"]), []).append(x["name"])
    heads = {min(v) for v in alike.values()}
    want = {frozenset((min(v), n)) for v in alike.values() for n in v if n != min(v)}
    want |= {frozenset((a["name"], b["name"])) for a, b in itertools.combinations([x for x in parsed if x["name"] in heads], 2) if names.relation(a, b)}
    assert got == want and len(want) > 100


def test_common_surname(spark):
    """A surname of 500 companions keeps its nicknames, initials and typos."""
    rng = random.Random(3)
    crowd = {"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize() + " Pazetuton" for _ in range(500)}
    mine = ["Gwendolyn Pazetuton", "Wendy Pazetuton", "Gwendoly Pazetuton", "G. Q. Pazetuton"]
    labels = names.acts(spark.createDataFrame([(n, 1) for n in [*crowd, *mine]], "name string, n long"))
    act = {r["name"]: r["act"] for r in labels.collect()}
    assert act["Gwendolyn Pazetuton"] == act["Wendy Pazetuton"] == act["Gwendoly Pazetuton"]


def test_credited(spark):
    from pyspark.sql import functions as F

    titles = {"A (feat. X & Y)": ["X & Y"], "B ft. Z": ["Z"], "C [Q Q Rework]": ["Q Q"], "D - R Remix": ["R"], "E (Club Mix)": [], "F": [], "G (with H) - I Remix": ["H", "I"]}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", names.credited(F.col("t")).alias("c")).collect()} == titles


TRACKS = [
    ("t1", "Lonely Satellite (Radio Edit)", "DJ Mifyhudal", "D:\\Tonlager\\DJ Mifyhudal\\Garden\\01 - Lonely Satellite (Radio Edit).mp3"),
    ("t2", "Lonely Satellite", "DJ Mifyhudal", "D:\\Tonlager\\DJ Mifyhudal\\02 - Lonely Satellite.mp3"),
    ("t3", "Frühe Straße 8", "Светлана Жеши", "/srv/media/music/Светлана Жеши/Frühe Straße 8.mp3"),
    ("t4", "Frühe Straße 9", "Светлана Жеши", "/srv/media/music/Светлана Жеши/Frühe Straße 9.mp3"),
    ("t5", None, "", "F:\\Sets\\Solo Act\\Solo Act - Hidden Song.mp3"),
    ("t6", "", None, None),
]
SONGS = [
    ("s1", "Lnoely Satellite (Radio Edit)", "DJ Mifyhudal", "ingest/c/track_123.mp3", "t1"),
    ("s2", "03 lonely satellite - remastered", "", "Music/dj_mifyhudal/lonely_satellite.mp3", "t2"),
    ("s3", "Lonely Satellite (Club Mix)", "DJ Mifyhudal", "Music/DJ Mifyhudal/Lonely Satellite (Club Mix).mp3", None),
    ("s4", "FRÜHE STRASSE 8", "Светлана Жеши", None, "t3"),
    ("s5", "Hidden Song", "Solo Act", "Library/Solo Act - X/01 Hidden Song.mp3", "t5"),
    ("s6", None, None, None, None),
    ("s7", "Lonely Satellite", "Somebody Else", "upload/2021/Somebody Else/Lonely Satellite.mp3", None),
    ("s8", "Lonely Satellite", "DJ Mifyhudal", "", "t2"),
]


def test_matches(spark):
    tracks = spark.createDataFrame([(*t, "clash") for t in TRACKS], "metadata_id string, title string, artist string, full_path string, version string")
    songs = spark.createDataFrame([(*s[:4], "clash") for s in SONGS], "song_id string, title string, artist string, path string, act string")
    got = {r["song_id"]: r["metadata_id"] for r in matching.match(tracks, songs).collect()}
    assert got == {s[0]: s[4] for s in SONGS if s[4]}
    assert matching.match(tracks.limit(0), songs).count() == 0


def _keyed(spark, tracks, songs):
    a = spark.createDataFrame(tracks, "metadata_id string, title string, artist string, full_path string")
    b = spark.createDataFrame(songs, "song_id string, title string, artist string, path string")
    return matching.keys(a, 0, "metadata_id", "title", "artist", "full_path"), matching.keys(b, 1, "song_id", "title", "artist", "path")


def _brute(left, right):
    record = lambda df: [(r["id"], tuple(r[c] for c in matching._FIELDS)) for r in df.collect()]
    scores = {(i, j): round(matching.compare(x, y), 6) for i, x in record(left) for j, y in record(right)}
    return {k: v for k, v in scores.items() if v >= matching.LEAST}


def test_one_edit_away(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(90)]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(base)], "side int, t string")
    from pyspark.sql import functions as F

    number = {r["h"]: r["t"] for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    got = {(number[r["hash"]], number[r["near"]]) for r in matching._one_edit_away(df, "t").collect()}
    assert got == {(a, b) for a in base[1::2] for b in base[::2] if damerau(a, b) == 1} and len(got) > 5


def test_many_songs_of_one_track(spark):
    """A run of equal keys is compared as a whole, however long it is."""
    tracks = [(f"t{i:02}", "Lonely Satellite", f"Act Number {i}", f"/srv/media/music/Act Number {i}/Lonely Satellite.mp3") for i in range(20)]
    songs = [(f"s{i:02}{k:02}", "Lonely Satellite", f"Act Number {i}", "") for i in range(20) for k in range(50)]
    left, right = _keyed(spark, tracks, songs)
    got = {r["song_id"]: r["metadata_id"] for r in matching.assign(matching.candidates(left, right)).collect()}
    assert got == {s[0]: f"t{s[0][1:3]}" for s in songs}


def test_against_brute_force(spark, data):
    """All pairs of the smallest tables that the comparison accepts are found."""
    import pandas as pd

    t, s = pd.read_parquet(f"{data}/tracks.parquet"), pd.read_parquet(f"{data}/indexedsong.parquet")
    tracks = t[["metadata_id", "title", "artist", "full_path"]].astype(object).where(lambda x: x.notna(), None)
    songs = s[["song_id", "title", "artist", "path"]].astype(object).where(lambda x: x.notna(), None)
    left, right = _keyed(spark, tracks.values.tolist(), songs.values.tolist())
    got = {(r["metadata_id"], r["song_id"]): r["confidence"] for r in matching.candidates(left, right).collect()}
    assert got == _brute(left, right) and len(got) > 100


def test_large_title_block(spark):
    """In a block of one title, acts written in another order, with a typo or an initial meet at any distance."""
    names_ = [f"{given} {last}" for given in ("Nathaniel", "Elisabeth", "Xaver", "Ottilie") for last in ("Dipruhurell", "Jebuhuton", "Wazovimere", "Kolubraden", "Sutrapheld")]
    forms = [lambda g, x: f"{x} {g}", lambda g, x: f"{g} {x[:3]}{x[4]}{x[3]}{x[5:]}", lambda g, x: f"{g[0]} {x}", lambda g, x: f"{g} {x}"]
    tracks = [(f"t{i:02}", "La canción tímida (Live)", n, "") for i, n in enumerate(names_)]
    songs = [(f"s{i:02}{k}", title, form(*n.split()), "ingest/c/track_7") for i, n in enumerate(names_) for k, form in enumerate(forms) for title in [("La canción tímida (Live)", "a canción tímida (Live)")[k % 2]]]
    left, right = _keyed(spark, tracks, songs)
    got = {(r["metadata_id"], r["song_id"]): r["confidence"] for r in matching.candidates(left, right).collect()}
    assert got == _brute(left, right)
    assert {s[0] for s in songs} == {s for _, s in got}


def test_survivors(spark):
    cols = "metadata_id string, title string, artist string, album string, year string, length_seconds string, file_size string, full_path string, genre string, track_number string, album_artist string, label string, disc_number string, original_year string"
    row = lambda i, t, a, alb, ln, size, root: (i, t, a, alb, "1999", ln, size, f"{root}\\x\\{i}.mp3", None, "1", None, "", "1", None)
    rows = [
        row("a1", "River [Live]", "X & Y", "Good", "100", "1 MB", "D:\\One"), row("a2", "RIVER (live)", "X and Y", "Good", "1:42", "9 MB", "E:\\Two"), row("a3", "River (Live)", "x & y", "Bad", None, None, "F:\\Three"),
        row("b1", "River (Live)", "X & Y", "Other", "300", "1", "D:\\One"),
        row("c1", "Solo", "Z", "A", "10", "1", "D:\\One"), row("d1", None, "Z", "A", "10", "1", "D:\\One"), row("d2", None, "Z", "A", "10", "1", "D:\\One"),
        row("e1", "Tie", "Z", None, "10", "1", "D:\\One"), row("e2", "tie", "Z", "", "10", "1", "E:\\Two"),
    ]
    tracks = spark.createDataFrame(rows, cols)
    tech = spark.createDataFrame(
        [("a1", 1, 320, 100000), ("a2", 0, 999, None), ("a3", None, None, 101000), ("e1", None, None, None), ("zz", 1, 1, 1)], "metadata_id string, integrity_ok int, bitrate long, duration_ms long"
    )
    got = {r["metadata_id"]: r for r in survivors.surviving(tracks, tech).collect()}
    assert set(got) == {"a1", "e1"}
    assert got["a1"]["album"] == "Good" and got["a1"]["copies"] == 3 and got["e1"]["album"] is None
    assert survivors.surviving(tracks.limit(0), tech).count() == 0


def test_copied_votes_count_less(spark):
    """Two sources that repeat each other's errors lose against two independent ones."""
    said = [(f"g{i}", 0, "album", "wrong" if s in "AB" else "right", s, 1) for i in range(20) for s in "ABCD"]
    said += [(f"h{i}", 0, "album", "right" if s in "CDE" else "odd", s, 1) for i in range(20) for s in "ABCDE"]
    votes = spark.createDataFrame(said, "group_key string, cluster int, field string, value string, source string, n long")
    dep = {"A": {"B": 0.99}, "B": {"A": 0.99}}
    sources = spark.createDataFrame([(s, 0.8, dep.get(s, {})) for s in "ABCDE"], "source string, a double, dep map<string,double>")
    best = {r["group_key"]: (r["value"], r["p"]) for r in survivors._votes(votes, sources).collect() if r["p"] > 0.5}
    assert best["g0"][0] == "right" and best["g0"][1] > 0.8


def test_fusion_finds_true_values(spark):
    """Five independent sources and three that copy the worst one: fused values are right more often than those of a majority."""
    rng = random.Random(11)
    accuracy = {"A": 0.9, "B": 0.85, "C": 0.8, "D": 0.75, "E": 0.5}
    rows, truth, majority = [], {}, {}
    for g in range(600):
        truth[g] = f"true {g}"
        said = {s: truth[g] if rng.random() < a else f"false {g} {rng.randrange(20)}" for s, a in accuracy.items()}
        for copier in "FGH":
            said[copier] = said["E"] if rng.random() < 0.9 else (truth[g] if rng.random() < 0.5 else f"false {g} {rng.randrange(20)}")
        counts = {v: list(said.values()).count(v) for v in said.values()}
        majority[g] = max(sorted(counts), key=counts.get)
        rows += [(f"m{g}{s}", f"g{g}", 0, s, v) for s, v in said.items()]
    from pyspark.sql import functions as F

    held = spark.createDataFrame(rows, "metadata_id string, group_key string, cluster int, source string, album string")
    held = held.select("*", *[F.lit(None).cast("string").alias(f) for f in survivors.FIELDS if f != "album"])
    fused = {int(r["group_key"][1:]): r["value"] for r in survivors.fuse(held).collect()}
    right = sum(fused[g] == truth[g] for g in truth) / len(truth)
    plain = sum(majority[g] == truth[g] for g in truth) / len(truth)
    assert right >= 0.95 and right > plain + 0.05, (right, plain)

"""Similar titles in cells: pairs of brute force, copies by row, clusters of the loop."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from auricle.operators import dedup
from auricle.plans.feeds import q129_similar_groups

COLUMNS = "metadata_id string, artist string, title string, duration_ms long"


def tracks(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["river", "moth", "paper", "copper", "gate", "été", "夜の川", "a" * 230, "intro"]
    out = []
    for i in range(n):
        title = " ".join(rng.choices(words, k=rng.randint(1, 4)))
        if rng.random() < 0.5:
            at = rng.randrange(len(title))
            title = title[:at] + rng.choice(["", "x", "s"]) + title[at + 1 :]
        out.append((f"{rng.randrange(10**6):06}{i:04}", rng.choice(["Act", "act ", "Other"]), title, rng.choice([None, -3000, 4999, 5000, 100000, 105000, 105001, rng.randrange(300000)])))
    return out


def near(a: tuple, b: tuple, least: float) -> bool:
    a, b = sorted((a, b))
    return (
        a[1].strip().lower() == b[1].strip().lower()
        and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 5000)
        and SequenceMatcher(None, a[2].strip().lower(), b[2].strip().lower()).ratio() >= least
    )


@pytest.mark.parametrize("block", [8000, 5])
@pytest.mark.parametrize("least", [0.85, 0.6])
def test_pairs(spark, monkeypatch, block, least):
    rows = [r for r in tracks(400, 5) if r[2].strip()]
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and near(a, b, least)}
    assert len(want) > 40
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "PAIRS", 100)
    got = [tuple(r) for r in dedup.similar_pairs(spark.createDataFrame(rows, COLUMNS), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_clusters(spark):
    """Rows that are equal but for the id follow the first of them, as in the loop over rows."""
    base = tracks(60, 9)
    rows = [(f"{random.Random(i).randrange(10**6):06}{i:04}", *base[i % 60][1:]) for i in range(200)]
    rows = sorted(r for r in rows if r[2].strip())
    taken, want = set(), set()
    for i, a in enumerate(rows):
        if a[0] not in taken:
            hit = [b[0] for b in rows[i + 1 :] if b[0] not in taken and near(a, b, 0.85)]
            if hit:
                taken |= {a[0], *hit}
                want |= {(a[0], b) for b in hit}
    got = [tuple(r) for r in dedup.fuzzy_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_by_row(spark, monkeypatch):
    """One act with all rows: few copies of a row, where once it had one for each of the act's 40 blocks, and bounded cells."""
    monkeypatch.setattr(dedup, "BLOCK", 100)
    rows = [(f"{i:05}", "Various Artists", f"title {i % 700}", i * 137 % 400_000 if i % 20 else None) for i in range(4000)]
    cells = dedup._cells(dedup._keyed(spark.createDataFrame(rows, COLUMNS)), 0.85)
    assert cells.count() <= 10 * len(rows)
    assert cells.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 400


def test_rows_of_small_acts_go_once(spark):
    """Acts of few rows are cells of their own, where once every row had a copy for each span it meets."""
    rows = [(f"{i:05}", f"Act {i % 150}", f"title {i % 700}", i * 137 % 400_000 if i % 20 else None) for i in range(1500)]
    cells = dedup._cells(dedup._keyed(spark.createDataFrame(rows, COLUMNS)), 0.85)
    assert cells.count() == len(rows)


@pytest.mark.parametrize("block", [8000, 100])
def test_pairs_of_many_rows(spark, monkeypatch, block):
    """Acts of few and of many rows, durations of any size, cells in which rows have few and many others to meet."""
    rng = random.Random(4)
    rows = [(f"{i:04}", rng.choice(["Act"] * 5 + [f"act {k}" for k in range(9)]), f"{rng.choice(['red', 'blue', 'grey'])} {rng.choice(['moth', 'gate', 'gates'])}{rng.randrange(12)}", rng.choice([None, -(2**40), 0, 2**40, rng.randrange(90_000)])) for i in range(700)]
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if near(a, b, 0.85)}
    monkeypatch.setattr(dedup, "BLOCK", block)
    got = [tuple(r) for r in dedup.similar_pairs(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("few", [500_000, 0])
def test_repeated_rows(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "FEW", few)
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", None), (4, None, "y"), (5, None, "z")], "id int, k string, m string")
    told = dedup.repeated(rows, {"one": [F.col("k")], "both": [F.col("k"), F.col("m")], "other": [F.col("m")]})
    assert told.columns == ["id", "k", "m", "one", "both", "other"]
    assert sorted((r.id, r.one, r.both, r.other) for r in told.collect()) == [(1, True, False, True), (2, True, False, False), (3, False, False, True), (4, True, False, False), (5, True, False, False)]


@pytest.mark.parametrize("few", [500_000, 0])
def test_similar_groups(spark, monkeypatch, tmp_path, few):
    """q129 against loops: similar titles win over equal ends, those over equal texts; versions beside them."""
    monkeypatch.setattr(dedup, "FEW", few)
    rng = random.Random(2)
    rows, lengths = [], []
    for i in range(260):
        title = rng.choice([None, "", " ", "River", "river ", "Rivers", "Moth (Remix)", "Moth - Live", "Moth", "A title of more than forty letters, and some", "A title of more than Forty letters, and some"])
        rows.append((f"{i * 7919 % 1000:04}", title, rng.choice([None, "", "Act", " act", "Another act with a long name", "B" * 30]), rng.choice([None, 200.5, 300.0])))
        if i % 6:
            lengths.append((rows[-1][0], rng.choice([None, 1000, 5000, 9000, 60_000])))
    t = spark.createDataFrame(rows, "metadata_id string, title string, artist string, length_seconds double")
    t.write.parquet(f"{tmp_path}/tracks.parquet")
    spark.createDataFrame(lengths, "metadata_id string, duration_ms long").write.parquet(f"{tmp_path}/technical_features.parquet")
    made = t.select("metadata_id", F.concat_ws("|", "artist", "title", "length_seconds"), F.lower(F.trim("artist")), F.lower(F.trim("title")), F.lower(dedup.base_title(F.col("title")))).collect()
    by_id, ms = {r[0]: r for r in sorted(made)}, dict(lengths)

    def groups(key, among):
        out = {}
        for i in sorted(among):
            out.setdefault(key(by_id[i]), []).append(i)
        return {i: g[0] for g in out.values() if len(g) > 1 for i in g}

    full = groups(lambda r: r[1], by_id)
    part = groups(lambda r: r[1] if len(r[1]) <= 40 else r[1][:20] + r[1][-20:], set(by_id) - set(full))
    remix = groups(lambda r: (r[2], r[4]), [i for i, r in by_id.items() if r[2] and r[4]])
    ids, stars = [i for i, r in by_id.items() if r[2] and r[3]], {}
    for k, a in enumerate(ids):
        if a not in stars:
            hit = [b for b in ids[k + 1 :] if b not in stars and near((a, by_id[a][2], by_id[a][3], ms.get(a)), (b, by_id[b][2], by_id[b][3], ms.get(b)), 0.85)]
            stars |= {i: a for i in [a, *hit]} if hit else {}
    want = set()
    for i in by_id:
        group = "f" + stars[i] if i in stars else "g" + part[i] if i in part else "g" + full[i] if i in full else None
        if group or i in remix:
            want.add((i, group, "r" + remix[i] if i in remix else None))
    assert full and part and stars and remix
    got = [(r.metadata_id, r.duplicate_group, r.remix_group) for r in q129_similar_groups(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want

"""Greedy operators against the row-by-row loops."""

import random
from difflib import SequenceMatcher

from auricle.operators import dedup, playlist, selection


def greedy(rows):
    seen_d, seen_r, out = set(), set(), []
    for i, d, r in rows:
        if (d and d in seen_d) or (r and r in seen_r):
            continue
        out.append(i)
        seen_d.add(d)
        seen_r.add(r)
    return out


def test_first_of_groups(spark):
    rng = random.Random(5)
    for n in (0, 1, 60):
        rows = [(f"{i:03}", rng.choice([None, "", "A", "B", "C", "D"]), rng.choice([None, "", "R", "S", "T"])) for i in range(n)]
        rows += [("x1", "P", None), ("x2", "P", "Q"), ("x3", None, "Q")]
        df = spark.createDataFrame(rows, "metadata_id string, duplicate_group string, remix_group string").repartition(3)
        got = selection.first_of_groups(df, "metadata_id", "metadata_id", ["duplicate_group", "remix_group"])
        assert sorted(r[0] for r in got.collect()) == greedy(rows)


def test_star_clusters(spark):
    rng = random.Random(7)
    edges = [(f"{a:02}", f"{b:02}") for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.12]
    seen, want = set(), set()
    for a in sorted({x for e in edges for x in e}):
        if a in seen:
            continue
        hit = [b for x, b in edges if x == a and b not in seen]
        if hit:
            seen |= {a, *hit}
            want |= {(a, b) for b in hit}
    got = selection.star_clusters(spark.createDataFrame(edges, "a string, b string"))
    assert {(r["seed"], r["member"]) for r in got.collect()} == want
    assert selection.star_clusters(spark.createDataFrame([], "a string, b string")).count() == 0


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = ["river", "rivers", "moth", "paper moth", "paper moths", "copper", "coppers gate", "copper gate", None, ""]
    rows = [(f"{i:03}", rng.choice(["Act", "act ", "Other", None]), rng.choice(words), rng.choice([None, 100000, 103000, 110000])) for i in range(70)]
    df = spark.createDataFrame(rows, "metadata_id string, artist string, title string, duration_ms long")
    want = {
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[0] < b[0] and a[1] and b[1] and a[2] and b[2] and a[1].strip().lower() == b[1].strip().lower()
        and SequenceMatcher(None, a[2], b[2]).ratio() >= 0.85 and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 5000)
    }
    for block in (2000, 7):
        monkeypatch.setattr(dedup, "BLOCK", block)
        assert {tuple(r) for r in dedup.similar_pairs(df).collect()} == want


def library(spark, n=40):
    rng = random.Random(11)
    rows = [
        (f"{i:03}", rng.choice([None, "8A", "8B", "9A", "2A", "bad"]), rng.choice([None, 90.0, 120.0, 128.0]), rng.choice([None, 0.2, 0.5, 0.9]), rng.choice([None, 5, 500]), None, None)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(
        rows, "metadata_id string, camelot_key string, bpm double, energy double, listeners long, duplicate_group string, remix_group string"
    )


def test_energy_arc_order(spark):
    rows, df = library(spark)
    low = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]))[:15]
    k = max(0, min(int(len(low) * 0.6), len(low) - 1))
    want = [r[0] for r in low[: k + 1]] + [r[0] for r in sorted(low[k + 1 :], key=lambda r: -r[3])]
    got = playlist.energy_arc(df, {"limit": 15}).orderBy("position").collect()
    assert [r["metadata_id"] for r in got] == want


def test_chains(spark):
    rows, df = library(spark)
    pool = [(r[0], r[1]) for r in rows if r[1] is not None]
    want = playlist.chain(pool, "000" if rows[0][1] else pool[0][0], dict(pool)[pool[0][0]], 12)
    got = playlist.camelot_chain(df, {"seed_id": pool[0][0], "limit": 12}).orderBy("position").collect()
    assert [r["metadata_id"] for r in got] == want
    assert len(playlist.harmonic_chain(df, {"limit": 10}).collect()) == 10


def test_unknown_strategy(spark):
    try:
        playlist.generate("nope", library(spark)[1], {})
    except ValueError:
        return
    raise AssertionError


def test_groups_inside_groups_and_overlapping(spark):
    """Groups of one kind inside the other, equal ones, and chains such as (A), (A, R), (R), against the loop over rows."""
    rng = random.Random(9)
    rows = [(f"{i:03}", rng.choice([None, "", *"ABCDEFGH"]), rng.choice([None, "", *"RSTUVWXYZ"])) for i in range(60)]
    rows += [(f"x{i:02}", f"in{i % 4}", f"out{i % 2}") for i in range(12)] + [(f"y{i:02}", f"same{i % 3}", f"also{i % 3}") for i in range(9)]
    rows += [("z1", "chain", None), ("z2", "chain", "link"), ("z3", None, "link"), ("z4", "alone", None), ("z5", "alone", None)]
    seen_d, seen_r, want = set(), set(), []
    for i, d, r in sorted(rows):
        if (d and d in seen_d) or (r and r in seen_r):
            continue
        want.append(i)
        seen_d |= {d} - {None, ""}
        seen_r |= {r} - {None, ""}
    df = spark.createDataFrame(rows, "id string, d string, r string")
    for groups in (["d", "r"], ["r", "d"]):
        assert sorted(x["id"] for x in selection.first_of_groups(df, "id", "id", groups).collect()) == want
    assert "z1" in want and "z3" in want

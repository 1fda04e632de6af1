"""Best fuzzy songs against a loop over all of them; names and titles of any length."""

import random
from difflib import SequenceMatcher

import pytest

from auricle.operators import resolve


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() * 100


@pytest.mark.parametrize("block", [4000, 7])
def test_best_of_all(spark, monkeypatch, block):
    rng = random.Random(8)
    words = ["river", "moth", "paper", "copper", "z" * 70, "夜の川"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3)))[rng.randint(0, 2) :]
    acts = ["the band", "band", "bands", "other act", "act other", "b" * 66, ""]
    songs = [(f"s{i:03}", name(), rng.choice(acts)) for i in range(90)]
    rows = [(f"t{i:03}", name(), rng.sample(acts[:6], 2)) for i in range(60)]
    want = {}
    for i, title, keys in rows:
        for sid, t, a in [s for s in songs if s[1] == title] or songs:
            x, y = ratio(title, t), max(ratio(k, a) if a else 0 for k in keys)
            if x >= 70 and y >= 70:
                want[i] = min(want.get(i, (0, "")), (-round(x * 0.6 + y * 0.4, 6), sid))
    assert len(want) > 30
    monkeypatch.setattr(resolve, "BLOCK", block)
    got = resolve.best_fuzzy(
        spark.createDataFrame(rows, "id string, title_key string, artist_keys array<string>"),
        spark.createDataFrame(songs, "song_id string, title_key string, artist_key string"),
    )
    assert {r["id"]: (-round(r["score"], 6), r["song_id"]) for r in got.collect()} == want


def test_ratios_do_not_grow_with_shared_titles(spark, monkeypatch):
    """Artists of songs and rows that share a title are compared once, not once for each pair of a row and a song."""
    monkeypatch.setattr(resolve, "percent_ratio", None, raising=False)
    rows = spark.createDataFrame([(f"t{i}", "live", ["band"]) for i in range(300)], "id string, title_key string, artist_keys array<string>")
    songs = spark.createDataFrame([(f"s{i:03}", "live", "bands") for i in range(300)], "song_id string, title_key string, artist_key string")
    got = resolve.best_fuzzy(rows, songs).collect()
    assert len(got) == 300 and {r["song_id"] for r in got} == {"s000"}

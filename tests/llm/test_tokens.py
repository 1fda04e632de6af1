"""Ids against an independent encoder, and mixing against brute force."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auricle.llm import mixing, tokens

if not os.path.exists(tokens.DEFAULT_VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)
RANKS = tokens.read_vocabulary()


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.Encoder(RANKS).ids(text) == reference().encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merge_is_leftmost_lowest(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranks = [RANKS.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == 1 << 40:
            break
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [RANKS[piece]] if piece in RANKS else [RANKS[p] for p in parts]
    assert tokens.merge(piece, RANKS) == want


def test_documents(spark):
    texts = [None, "", "  ", "<|endoftext|> x", "日本" * 4000, "x" * 30000, "héllo wörld", "héllo wörld"]
    df = spark.createDataFrame([(i, t, "s", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(df).collect()}
    assert got == {i: reference().encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0


def test_prefix_sums_and_budgets(spark):
    rows = [(i, "ab"[i % 5 == 0], i % 7) for i in range(200)] + [(1000, "big", 10**6)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    sums = mixing.prefix_sums(counts).collect()
    for s in ("a", "b", "big"):
        mine = sorted((r for r in sums if r["source"] == s), key=lambda r: (r["ends"], r["n_tokens"]))
        total = 0
        assert sum(r["n_tokens"] for r in mine) == mine[-1]["ends"]
        ends = sorted(r["ends"] - r["n_tokens"] for r in mine)
        assert ends[0] == total and len(mine) == sum(1 for r in rows if r[1] == s)


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9 + 1), "x" if i % 3 else "y", "c") for i in range(300)] + [(900, None, "x", "c"), (901, "w", None, "c")], "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("m", "x", 0.5, 1, 0.5), ("m", "y", 0.5, 2, 0.5), ("n", "y", 1.0, 3, 2.0), ("n", "none", 0.0, None, 2.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    chosen, plan = mixing.mix(docs, targets)
    report = {(r["mix_name"], r["source"]): r for r in mixing.shares(chosen, plan).collect()}
    size = {r["source"]: r["available"] for r in plan.collect()}
    for key, r in report.items():
        assert r["most_copies"] <= {"x": 1, "y": 2 if key[0] == "m" else 3, "none": 1}[key[1]]
    assert abs(report["m", "x"]["actual_share"] - 0.5) < 0.02
    assert report["n", "y"]["tokens"] == 3 * size["y"] and report["n", "y"]["shortfall"] > 0
    assert report["n", "none"]["tokens"] == 0
    again = {(r["mix_name"], r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(5), targets)[0].collect()}
    assert again == {(r["mix_name"], r["doc_id"], r["copies"]) for r in chosen.collect()}

"""Round trips through wrong decodings, and what must stay."""

import pytest
from pyspark.sql import functions as F

from auricle.llm import encoding as e

CLEAN = ["La rivière étrange", "Süße Wälder im Winter", "Canção do Verão", "Тихая дорога", "静かな海", "Le théâtre brûlée", "Don’t Borrow the Moth", "Příliš žlutý kůň", "Maçã em Vão"]


def damage(text, codec):
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode("utf-8"))


def frame(spark, titles):
    rows = [(f"{i:04}", t, None, "", f"D:\\Root{i % 2}\\x.mp3", "clash") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "metadata_id string, title string, artist string, album string, full_path string, value string")


@pytest.mark.parametrize("codec", ["cp1252", "latin1", "mac_roman", "cp437", "cp850"])
def test_undo(codec):
    for text in CLEAN:
        assert e.undo_utf8(damage(text, codec), codec) == text if not text.isascii() else True
        assert e.undo_utf8("plain ascii", codec) is None


def test_found_and_repaired(spark):
    cases = {damage("La rivière étrange", "cp1252"): "La rivière étrange", damage("Тихая дорога", "latin1"): "Тихая дорога", damage("Süße Wälder im Winter", "cp437"): "Süße Wälder im Winter",
             damage(damage("Canção do Verão", "cp1252"), "cp1252"): "Canção do Verão", "Тихая дорога".encode("cp1251").decode("latin1"): "Тихая дорога", "S��e W�lder": None}
    titles = CLEAN * 12 + [None, "", "ascii only", "x" * 50000, *cases, *list(cases)[:1]]
    got = {r["value"]: r["repaired"] for r in e.explain(frame(spark, titles)).collect()}
    assert got == cases
    assert e.damaged_fields(frame(spark, titles)).count() == len(cases) + 1


def test_empty(spark):
    assert e.explain(frame(spark, [None])).count() == 0
    assert e.explain(frame(spark, ["x"]).limit(0)).count() == 0


def test_every_broken_value_is_suspected(spark):
    bad = [damage(t, c) for t in CLEAN if not t.isascii() for c in e.BYTE_CODECS]
    df = spark.createDataFrame([(b,) for b in bad], "v string")
    assert [r["v"] for r in df.where(~e.suspicious(F.col("v"))).collect()] == []

"""One form for texts that look the same."""

import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auricle.llm import lookalikes as lo

SAME = ["Große Nächte", "静かなカーテン", "Тихая дорога", "Don’t – “x” — y", "Λευκή γέφυρα", "Łagodny řeka", "👩‍🎤 on", "क्‍ष", "", "DJ Иван", "a" * 30000]
FORMS = {
    "Ｃｏｂａｌｔ　Ｐⅼаｔｆоｒｍ": "Cobalt Platform", "ku\u0308hle uhr": "kühle uhr", "メロテ\u3099ィー": "メロディー", "L\u200ce\u00adt\u2060t\ufeffer": "Letter", "a\u2007b\u00a0c": "a b c",
    "Gаrԁen": "Garden", "Oriɡinаl": "Original", "Cһаѕe the Horizon": "Chase the Horizon", "Чужая рекa": "Чужая река", "gho\ufb06": "ghost", "Черн\u0438\u0306": "Черн\u0439", "１６": "16",
}


def test_forms():
    assert {k: lo.canonical(k) for k in FORMS} == FORMS
    assert [lo.canonical(x) for x in SAME] == SAME
    long = "ab ﬁ " * 20000
    assert lo.canonical(long) == "ab fi " * 20000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aéo\u0301\u0323eﬁｱﾞ가가\u0308n½²① ")))
def test_splicing_equals_whole_normalization(text):
    got = "".join(c for c in ud.normalize("NFKC", lo._SPACE.sub(" ", text)))
    assert lo.canonical(text) == got


def test_columns(spark):
    values = [None, *SAME, *FORMS, *FORMS]
    tracks = spark.createDataFrame([(f"{i}", v, None, "clash") for i, v in enumerate(values)], "metadata_id string, title string, artist string, value string")
    songs = spark.createDataFrame([("s", None)], "song_id string, title_key string")
    found = lo.disguised(lo.melt(tracks, songs)).collect()
    assert sorted(r["value"] for r in found) == sorted([*FORMS, *FORMS])
    whole = {r["value"]: r["canonical"] for r in lo.canonicalize(lo.melt(tracks, songs)).collect()}
    assert whole == {None: None} | {x: x for x in SAME} | FORMS
    assert lo.disguised(lo.melt(tracks.limit(0), songs)).count() == 0


def test_coarse_pattern_misses_nothing(spark):
    points = [chr(c) for c in range(0x80, 0x3000) if not 0xD800 <= c < 0xE000 and ud.category(chr(c)) not in ("Cn", "Cc", "Co", "Cs")]
    changed = [f"a{c}a" for c in points if lo.canonical(f"a{c}a") != f"a{c}a"]
    df = spark.createDataFrame([(c,) for c in changed], "v string")
    assert [hex(ord(r["v"][1])) for r in df.where(~lo.unstable(F.col("v"))).collect()] == []

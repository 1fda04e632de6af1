"""Parsing of raw lines against the csv module, rules, and clean rows."""

import csv
import io

from pyspark.sql import functions as F

from auricle.operators import malformed as m

HEAD = ";".join(m.HEADER) + ";"
SCHEMA = "record_id long, file_name string, line_no int, raw_line string, received_at timestamp, title string"


def lines(spark, rows, head=HEAD, name="f"):
    data = [(0, name, 1, head, None, "clash")] + [(i + 1, name, i + 2, r, None, "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def row(title="T", length="3:34", size="8.17 MB"):
    return f"{title};A;B;1;1999;{length};{size};1/1/2020;D:\\x\\;f.mp3;"


def found(df):
    return {r["rec_key"]: r["reasons"] for r in m.line_errors(df).collect()}


def test_reasons(spark):
    rows = [
        row(), row('"a; b"'), row('"say ""hi"""'), row('12" Version'), row("x").rstrip(";"), "", "   ", None, HEAD,
        row('"open'), row('"a"x'), row('"a "b" c"'), row() + "y;", "only", row(length="3:64"), row(length=""), row(size="12,3 MB"), row(size="5.3MB"),
        row("bad\x07"), row(length="n/a", size="?"), row('"swallowed;field"'), row("1:02:03", length="1:02:03"),
    ]
    got = found(lines(spark, rows))
    want = {10: "broken_quoting", 11: "broken_quoting", 12: "broken_quoting", 13: "wrong_field_count", 14: "wrong_field_count"}
    want |= {15: "invalid_length", 17: "invalid_size", 19: "control_character", 20: "invalid_length|invalid_size", 21: "swallowed_fields"}
    assert got == {str(k): v for k, v in want.items()}


def test_comma_dialect_and_repeats(spark):
    head = ",".join(f'"{h}"' for h in m.HEADER)
    good = '"T, x","","B","1","","560","8 KB","","p","f"'
    bad = '"T" y,"A","B","1","","560","8 KB","","p","f"'
    assert found(lines(spark, [good, good, bad, bad, '"T"," ","say ""x""","1","","","","","",""'], head)) == {"3": "broken_quoting", "4": "broken_quoting"}


def test_cells_match_csv(spark):
    texts = ['a;b', '"a;b";c', '"a""b";', ';;', '""', '"";""', 'x"y;z', '"x;""y"";z";w', "a" * 5000 + ';"' + 'q""' * 3000 + '"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", m.parse_cells(F.col("t"), F.lit(";")).alias("c")).collect()}
    for i, t in enumerate(texts):
        if t != 'x"y;z':
            assert got[i] == next(csv.reader(io.StringIO(t), delimiter=";")), t
    assert got[6] == ['x"y', "z"]


def test_clean_rows_are_the_rest(spark):
    df = lines(spark, [row(), row(length="x"), row('"q; r"', "1:00:01", "2.5 KB"), None])
    got = {r["record_id"]: r for r in m.clean_lines(df).collect()}
    assert set(got) == {1, 3}
    assert (got[3]["title"], got[3]["length_seconds"], got[3]["file_size"]) == ("q; r", 3601, 2560)
    assert m.clean_lines(df.limit(0)).count() == 0


def test_tracks_and_predicate_agree(spark):
    rows = [("a", None, None, None), ("b", "", "", ""), ("c", "x", "3:99", "1"), ("d", 'x","y', "9", "1 MB"), ("e", "Side A; B", "0x2", "∞")]
    df = spark.createDataFrame(rows, "metadata_id string, title string, length_seconds string, file_size string").withColumn("value", F.lit("clash"))
    bad = {r["rec_key"] for r in m.track_errors(df).collect()}
    assert bad == {"c", "d", "e"} == {r["metadata_id"] for r in df.where(m.is_malformed_track()).collect()}

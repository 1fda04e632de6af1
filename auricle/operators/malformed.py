"""Separate records that cannot be loaded from those that can.

Raw delimited lines are parsed into cells by a quote-aware state machine that
runs inside the JVM; parsed cells (of lines and of already loaded tables) are
exploded into (row, column, value), joined to a small rule table, evaluated by
the patterns in it, and failing cells are aggregated per row. The quoting of a
line and the number of its fields are cells of their own, so that every reason
comes from the table. Clean rows are what remains after an
anti join.

Defined results: a null or blank line and a header line are neither errors nor
rows; a file without a header line is read with the dialect its lines suggest
(``;`` unless the line starts with a double quote); a null cell passes every
rule; repeated lines are judged one by one under their own key; an empty table
gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.io import materialize

#: Columns of the export dialect, in order (fixed values).
HEADER = ["Title", "Artist", "Album", "Track", "Year", "Length", "Size", "Last Modified", "Path", "Filename"]

LENGTH = r"^(\d+|\d+:[0-5]\d|\d+:[0-5]\d:[0-5]\d)$"
SIZE = r"^(\d+|\d+(\.\d{1,2})? ?(KB|MB|GB))$"

#: column, reason, pattern, whether a match is an error (else a match is required)
RULES = [
    ("title", "control_character", r"[\x00-\x1F]", True),
    ("title", "swallowed_fields", r'"[;,]"|;(?=\S)', True),
    ("length", "invalid_length", LENGTH, False),
    ("size", "invalid_size", SIZE, False),
    ("line quoting", "broken_quoting", "^broken$", True),
    ("line fields", "wrong_field_count", f"^{len(HEADER)}$", False),
]
_FIELDS = {"title": "title", "length": "length_seconds", "size": "file_size"}


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as rows; their number is fixed, so the join may broadcast them."""
    return spark.createDataFrame(RULES, "column string, reason string, pattern string, bad boolean")


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def _quoted_cells(line: Column, sep: Column) -> Column:
    """State machine over the pieces between delimiters: struct(done, open, bad)."""

    def step(state: Column, piece: Column) -> Column:
        text = F.when(state["open"], F.concat(state["cur"], sep, piece)).otherwise(piece)
        return F.transform(
            F.array(text),
            lambda cur: _close(state, cur, cur.startswith('"'), _count(cur, '"') % 2 == 0),
        )[0]

    def _close(state: Column, cur: Column, quoted: Column, even: Column) -> Column:
        body = F.substr(cur, F.lit(2), F.length(cur) - 2)
        stray = F.instr(F.replace(body, F.lit('""'), F.lit("")), '"') > 0
        is_open = quoted & ~even
        bad = quoted & even & (~cur.endswith('"') | stray)
        cell = F.when(quoted, F.replace(body, F.lit('""'), F.lit('"'))).otherwise(cur)
        return F.struct(
            F.when(is_open, state["done"]).otherwise(F.concat(state["done"], F.array(cell))).alias("done"),
            F.when(is_open, cur).otherwise(F.lit("")).alias("cur"),
            is_open.alias("open"),
            (state["bad"] | bad).alias("bad"),
        )

    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("done"),
        F.lit("").alias("cur"),
        F.lit(False).alias("open"),
        F.lit(False).alias("bad"),
    )
    return F.aggregate(F.split(line, sep, -1), start, step)


def parse_cells(line: Column, sep: Column) -> Column:
    """``array<string>`` of unquoted cells, or null where the quoting is broken.

    Two shapes need no state machine: lines without any double quote, and lines
    in which every field is quoted and no field holds a double quote.
    """
    between = F.concat(F.lit('"'), sep, F.lit('"'))
    seams = (F.length(line) - F.length(F.replace(line, between, F.lit("")))) / 3
    all_quoted = line.startswith('"') & line.endswith('"') & (_count(line, '"') == seams * 2 + 2)
    inner = F.substr(line, F.lit(2), F.length(line) - 2)
    slow = _quoted_cells(line, sep)
    return (
        F.when(F.instr(line, '"') == 0, F.split(line, sep, -1))
        .when(all_quoted, F.split(inner, between, -1))
        .otherwise(F.transform(F.array(slow), lambda s: F.when(~s["bad"] & ~s["open"], s["done"]))[0])
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Record lines with their dialect and cells: record_id, file_name, line_no, cells, broken.

    The dialect is the header's (line 1 of the file). Headers are stored, so that Spark knows their size: below its
    threshold they are broadcast and the lines do not move; beyond it the join splits a file that has many lines.
    """
    head = materialize(lines.where(F.col("line_no") == 1).groupBy("file_name").agg(F.min("raw_line").alias("header")))
    body = lines.where((F.col("line_no") > 1) & (F.trim(F.regexp_replace("raw_line", r"[\s\x00]+", " ")) != "")).select(
        "record_id", "file_name", "line_no", "raw_line"
    )
    text = F.coalesce("header", "raw_line")
    sep = F.when(text.startswith('"'), F.lit(",")).otherwise(F.lit(";"))
    cells = parse_cells(F.col("raw_line"), F.col("sep"))
    ended = (F.col("sep") == ";") & (F.try_element_at("cells", F.lit(-1)) == "")
    return (
        body.join(head, "file_name", "left")
        .where(F.col("header").isNull() | (F.col("raw_line") != F.col("header")))
        .withColumn("sep", sep)
        .withColumn("cells", cells)
        .withColumn("broken", F.col("cells").isNull())
        .withColumn("cells", F.when(ended, F.slice("cells", 1, F.size("cells") - 1)).otherwise(F.col("cells")))
        .select("record_id", "file_name", "line_no", "cells", "broken")
    )


def failing_cells(cells: DataFrame) -> DataFrame:
    """(src_table, rec_key, column, value) joined to the rules; one row per broken rule."""
    rules = F.broadcast(rule_table(cells.sparkSession))
    hit = F.rlike("value", F.col("pattern"))
    return (
        cells.where(F.col("value").isNotNull())
        .join(rules, "column")
        .where(F.when(F.col("bad"), hit).otherwise((F.col("value") != "") & ~hit))
        .select("src_table", "rec_key", "reason")
    )


def _aggregate(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("src_table", "rec_key").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons")
    )


def _line_cells(parsed: DataFrame) -> DataFrame:
    """Cells of the judged columns; lines of another shape have only the cells of their shape."""
    at = {name: HEADER.index(head) for name, head in (("title", "Title"), ("length", "Length"), ("size", "Size"))}
    whole = ~F.col("broken") & (F.size("cells") == len(HEADER))
    cell = lambda name, value: F.struct(F.lit(name).alias("column"), value.alias("value"))
    fields = F.array(*[cell(n, F.col("cells")[i]) for n, i in at.items()])
    shape = F.array(cell("line quoting", F.when(F.col("broken"), "broken")), cell("line fields", F.when(~F.col("broken"), F.size("cells").cast("string"))))
    return parsed.select(F.col("record_id").cast("string").alias("rec_key"), F.explode(F.when(whole, fields).otherwise(shape)).alias("c")).select(
        F.lit("track_import_lines").alias("src_table"), "rec_key", "c.column", "c.value"
    )


def line_errors(lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(src_table, rec_key, reasons) of the lines that do not load."""
    return _aggregate(failing_cells(_line_cells(parse_lines(lines) if parsed is None else parsed)))


def track_failures(tracks: DataFrame) -> DataFrame:
    """(src_table, rec_key, reason), one row per broken rule of a loaded track."""
    pairs = [
        F.struct(F.lit(n).alias("column"), F.col(c).alias("value"))
        for n, c in _FIELDS.items()
    ]
    cells = tracks.select(F.col("metadata_id").alias("rec_key"), F.explode(F.array(*pairs)).alias("c")).select(
        F.lit("tracks").alias("src_table"), "rec_key", "c.column", "c.value"
    )
    return failing_cells(cells)


def track_errors(tracks: DataFrame) -> DataFrame:
    """(src_table, rec_key, reasons) of the tracks with an invalid title, length or size."""
    return _aggregate(track_failures(tracks))


def is_malformed_track() -> Column:
    """The same rules as one predicate over a tracks row, for operators that leave such rows out."""
    out = F.lit(False)
    for column, _, pattern, bad in RULES:
        if column not in _FIELDS:
            continue
        value = F.col(_FIELDS[column])
        hit = value.rlike(pattern) if bad else (value != "") & ~value.rlike(pattern)
        out = out | F.coalesce(hit, F.lit(False))
    return out


def length_in_seconds(text: Column) -> Column:
    """Seconds of ``560``, ``3:34`` or ``1:02:03``; null where empty or invalid."""
    parts = F.transform(F.split(text, ":"), lambda p: F.try_to_number(p, F.lit("999999999999")).cast("long"))
    return F.when(text.rlike(LENGTH), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p))


def size_in_bytes(text: Column) -> Column:
    """Bytes of ``8.17 MB``, ``5.3MB`` or ``5632168`` (KB = 1024); null where empty or invalid."""
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("decimal(30,2)")
    unit = F.regexp_extract(text, r"(KB|MB|GB)$", 1)
    factor = F.when(unit == "KB", 1024).when(unit == "MB", 1024**2).when(unit == "GB", 1024**3).otherwise(1)
    return F.when(text.rlike(SIZE), F.floor(number * factor).cast("long"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Typed rows of all lines without an error, by an anti join on the error keys."""
    parsed = parse_lines(lines)
    bad = line_errors(lines, parsed).select(F.col("rec_key").cast("long").alias("record_id"))
    cell = {head: F.col("cells")[i] for i, head in enumerate(HEADER)}
    return parsed.join(bad, "record_id", "left_anti").select(
        "record_id",
        "file_name",
        "line_no",
        F.nullif(cell["Title"], F.lit("")).alias("title"),
        F.nullif(cell["Artist"], F.lit("")).alias("artist"),
        F.nullif(cell["Album"], F.lit("")).alias("album"),
        cell["Track"].try_cast("int").alias("track_number"),
        F.regexp_extract(cell["Year"], r"^(\d{4})", 1).try_cast("int").alias("year"),
        length_in_seconds(cell["Length"]).alias("length_seconds"),
        size_in_bytes(cell["Size"]).alias("file_size"),
        cell["Path"].alias("path"),
        cell["Filename"].alias("filename"),
    )

"""CSV input: dialects, column types and typed cells, each as one job over all files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import lookup_join
from .files import plain_path

# What a CSV cell or file may look like.
NULL_TEXTS = ("NA", "N/A", "#N/A", "null", "NULL")
TAB = "\t"
SEPARATORS = (",", ";", TAB, "|")
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|NaN)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$"
COMMA_FLOAT = r"^[+-]?[0-9]+,[0-9]+$"
POINT_FLOAT = r"^[+-]?[0-9]*\.[0-9]+$"
#: One bit per class of cells.
CLASSES = {"integer": 1, "float": 2, "boolean": 4, "date": 8, "datetime": 16, "text": 32}


# -- lines and records ----------------------------------------------------------------------


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(source, block, at, part, line)``: text lines in file order along ``(block, at, part)``.

    Lines end at ``\\n`` or at a lone ``\\r``; a ``\\r`` stays at the end of its line. *part* numbers the lines between two ``\\n``
    and *last* marks the one that a ``\\n`` follows.
    """
    df = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else list(paths))
    cut = F.when(F.col("value").contains("\r"), F.split("value", r"(?<=\r)(?!$)")).otherwise(F.array("value"))
    df = df.select(
        plain_path(F.col("_metadata.file_path")).alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        cut.alias("cut"),
    )
    df = df.select("source", "block", "at", F.size("cut").alias("parts"), F.posexplode("cut").alias("part", "line"))
    return df.withColumn("last", F.col("part") + 1 == F.col("parts")).drop("parts")


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(source, no, record, open)``: the records of CSV files, numbered from 0 (the header) in each file; blank lines are none.

    A line break inside quotes does not end a record. Whether a line starts inside quotes depends on all quotes before it, so
    the state is a prefix scan: every block of a file is counted for both states it may start in, a running parity
    over one row per block says which of them holds, and then the lines of each block know their state and number. Only
    records of several lines are put together. *open* marks lines after a quote that the file never closes: each of
    them is a record.
    """
    lines = read_lines(spark, paths)
    odd = F.pmod(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))), F.lit(2)).cast("int")
    inside = Window.partitionBy("source", "block").orderBy("at", "part")
    lines = lines.withColumn("odd", odd)
    lines = lines.withColumn("turn", F.pmod(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("odd"), F.lit(2)))
    blank = (F.trim(F.replace("line", F.lit("\r"), F.lit(""))) == "") | ((F.col("block") == 0) & (F.trim("line") == "\uFEFF"))
    lines = lines.withColumn("blank", blank)
    # "turn" is the state a line starts in if its block starts outside quotes; inside them, it is the other one.
    begins = {s: (F.col("turn") == s) & ~F.col("blank") for s in (0, 1)}
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({f"begun{s}": F.sum(test.cast("bigint")).over(upto) for s, test in begins.items()})
    counts = [F.count(F.when(test, 1)).alias(f"n{s}") for s, test in begins.items()]
    blocks = lines.groupBy("source", "block").agg(F.pmod(F.sum("odd"), F.lit(2)).alias("flip"), *counts)
    file = Window.partitionBy("source").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    blocks = blocks.withColumn("state", F.pmod(F.coalesce(F.sum("flip").over(before), F.lit(0)), F.lit(2)))
    blocks = blocks.withColumn("n", F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1")))
    blocks = blocks.select(
        "source", "block", "state", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        (F.pmod(F.sum("flip").over(whole), F.lit(2)) == 1).alias("broken"), F.sum("n").over(whole).alias("all"),
    )
    rows = lookup_join(lines, blocks, ["source", "block"])
    rows = rows.withColumn("starts", F.pmod(F.col("turn") + F.col("state"), F.lit(2)) == 0)
    rows = rows.withColumn("no", F.col("earlier") + F.when(F.col("state") == 0, F.col("begun0")).otherwise(F.col("begun1")) - 1)
    rows = rows.filter(~(F.col("starts") & F.col("blank")))
    # The last record of a file that ends inside quotes is the one whose quote is not closed.
    open_ = F.col("broken") & (F.col("no") == F.col("all") - 1)
    alone = open_ | (F.col("starts") & (F.col("odd") == 0))
    text = F.regexp_replace(F.when((F.col("block") == 0) & (F.col("no") == 0), F.regexp_replace("line", "^\uFEFF", "")).otherwise(F.col("line")), r"\r$", "")
    single = rows.filter(alone).select("source", "no", text.alias("record"), open_.alias("open"))
    ended = F.concat("line", F.when(F.col("last"), "\n").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "part", ended.alias("text"))))
    several = rows.filter(~alone).groupBy("source", "no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("record"))
    record = F.regexp_replace(F.when(F.col("no") == 0, F.regexp_replace("record", "^\uFEFF", "")).otherwise(F.col("record")), r"\r?\n$|\r$", "")
    return single.unionByName(several.select("source", "no", record.alias("record"), F.lit(False).alias("open")))


# -- dialect ------------------------------------------------------------------------------


def line_dialects(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, separator, decimal_comma, binary)`` from lines ``(by, line, head)``; blank lines do not count, *head* marks the first other one.

    The separator found equally often on every line wins, then the one that makes most columns in the first. Each line gives the number of
    every separator outside quotes and whether a cell between them reads as a number with a decimal comma or point (spaces and
    quotes around it do not count; commas never mark decimals between comma-separated cells). One hash aggregate compares the lines.
    """
    seen = {f"n{i}": F.length("bare") - F.length(F.replace("bare", F.lit(s), F.lit(""))) for i, s in enumerate(SEPARATORS)}
    for i, separator in enumerate(SEPARATORS):
        edge = re.escape(separator)
        for name, pattern in (("comma", COMMA_FLOAT), ("point", POINT_FLOAT)):
            cell = rf'\s*"*{pattern[1:-1]}"*\s*'
            # A search through the line only where it has the separator at all.
            held = F.when(F.col("line").contains(separator), F.col("line").rlike(f"(^|{edge}){cell}($|{edge})")).otherwise(F.col("line").rlike(f"^{cell}$"))
            seen[f"{name}{i}"] = F.lit(False) if separator == "," else held
    used = F.trim(F.replace("line", F.lit("\r"), F.lit(""))) != ""
    rows = lines.select(*by, "line", "head", used.alias("used"), F.when(F.col("line").contains('"'), F.regexp_replace("line", '"[^"]*"?', "")).otherwise(F.col("line")).alias("bare")).withColumns(seen)
    aggregates = [F.max(F.col("line").contains("\x00")).alias("binary")]
    for i in range(len(SEPARATORS)):
        count = F.when(F.col("used"), F.col(f"n{i}"))
        aggregates += [F.min(count).alias(f"least{i}"), F.max(count).alias(f"most{i}"), F.max(F.when(F.col("head"), count)).alias(f"top{i}")]
        aggregates += [F.max(F.col(f"{name}{i}") & F.col("used") & ~F.col("head")).alias(f"{name}{i}") for name in ("comma", "point")]
    found = rows.groupBy(*by).agg(*aggregates)
    scores = []
    for i, separator in enumerate(SEPARATORS):
        same = F.col(f"least{i}") == F.col(f"most{i}")
        decimal = F.col(f"comma{i}") & ~F.col(f"point{i}") & F.lit(separator != ",")
        score = F.struct(same.alias("same"), F.col(f"top{i}").alias("columns"), F.lit(-i).alias("rank"), F.lit(separator).alias("separator"), decimal.alias("decimal_comma"))
        scores.append(F.when(F.col(f"top{i}") > 0, score))
    best = F.array_max(F.array_compact(F.array(*scores)))
    tabs = F.col(f"comma{SEPARATORS.index(TAB)}") & ~F.col(f"point{SEPARATORS.index(TAB)}")
    return found.select(
        *by, F.coalesce(best["separator"], F.lit(",")).alias("separator"), F.coalesce(best["decimal_comma"], F.lit(False)).alias("decimal_comma"),
        F.coalesce(tabs, F.lit(False)).alias("tab_decimal_comma"), F.coalesce("binary", F.lit(False)).alias("binary"),
    )


def text_lines(text: Column) -> Column:
    """The non-blank lines of a text."""
    whole = F.when(text.startswith("\uFEFF"), F.substr(text, F.lit(2))).otherwise(text)
    # Splitting at one plain character is much faster than at alternatives.
    whole = F.when(whole.contains("\r"), F.regexp_replace(whole, "\r\n?", "\n")).otherwise(whole)
    return F.filter(F.split(whole, "\n"), lambda line: F.trim(line) != "")


def text_dialects(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """:func:`line_dialects` of texts, each taken as a CSV file of its own; *by* is its key."""
    lines = df.select(*by, F.posexplode_outer(text_lines(F.col(text))).alias("at", "line"))
    return line_dialects(lines.select(*by, "line", (F.coalesce("at", F.lit(0)) == 0).alias("head")), by).drop("tab_decimal_comma", "binary")


def file_dialects(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(source, separator, decimal_comma, error)`` for each CSV file in *files* (``path``), from all of its lines."""
    paths = [row.path for row in files.select("path").collect()]  # names only
    if not paths:
        return spark.createDataFrame([], "source string, separator string, decimal_comma boolean, error string")
    lines = read_lines(spark, paths).withColumn("line", F.regexp_replace("line", "^\uFEFF", ""))
    filled = lines.filter(F.trim(F.replace("line", F.lit("\r"), F.lit(""))) != "")
    starts = filled.groupBy("source").agg(F.min("block").alias("first"))
    first = filled.join(starts.withColumnRenamed("source", "of"), (F.col("source") == F.col("of")) & (F.col("block") == F.col("first"))).groupBy("source")
    first = first.agg(F.min(F.col("at") * F.lit(1 << 10) + F.least("part", F.lit((1 << 10) - 1))).alias("top"))
    place = F.col("at") * F.lit(1 << 10) + F.least("part", F.lit((1 << 10) - 1))
    rows = lookup_join(lines, first, ["source"]).withColumn("head", F.coalesce(place == F.col("top"), F.lit(False)))
    found = line_dialects(rows, ["source"])
    tsv = F.col("source").rlike(r"(?i)\.tsv$")
    error = F.when(F.col("binary"), "neither a Parquet nor a CSV file")
    separator, comma = F.when(tsv, TAB).otherwise(F.col("separator")), F.when(tsv, F.col("tab_decimal_comma")).otherwise(F.col("decimal_comma"))
    return found.select("source", separator.alias("separator"), comma.alias("decimal_comma"), error.alias("error"))


# -- types ----------------------------------------------------------------------------------


def null_text(cell: Column, kind: str = "text") -> Column:
    """The cell, or NULL for the texts that mean a missing value. A quoted empty cell is a text."""
    missing = NULL_TEXTS if kind == "text" else ("", *NULL_TEXTS)
    return F.when(~cell.isin(*missing), cell)


def _point(cell: Column, decimal_comma: bool) -> Column:
    return F.replace(cell, F.lit(","), F.lit(".")) if decimal_comma else cell


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "r'" + value + "'"


def cell_class(name: str, decimal_comma: bool = False) -> Column:
    """The narrowest type the cell of a column reads as, as one bit of :data:`CLASSES`; 0 when missing."""
    cell = _quote(name)
    missing = ", ".join(_text(t) for t in ("", *NULL_TEXTS))
    number = f"replace({cell}, ',', '.')" if decimal_comma else cell
    plain = f"NOT contains({cell}, '.') AND " if decimal_comma else ""
    return F.expr(
        f"""CASE WHEN {cell} IS NULL OR {cell} IN ({missing}) THEN 0
        WHEN {cell} RLIKE {_text(INTEGER)} AND try_cast({cell} AS BIGINT) IS NOT NULL THEN {CLASSES["integer"]}
        WHEN {plain}{number} RLIKE {_text(FLOAT)} THEN {CLASSES["float"]}
        WHEN {cell} IN ('true', 'false') THEN {CLASSES["boolean"]}
        WHEN {cell} RLIKE {_text(DATE)} AND try_cast({cell} AS DATE) IS NOT NULL THEN {CLASSES["date"]}
        WHEN {cell} RLIKE {_text(DATETIME)} AND try_cast(replace({cell}, ',', '.') AS TIMESTAMP) IS NOT NULL
        THEN {CLASSES["datetime"]} ELSE {CLASSES["text"]} END"""
    )


def cell_classes(cells: DataFrame, columns: Sequence[str], by: Sequence[str] = (), decimal_comma: bool = False) -> DataFrame:
    """One aggregate over all rows: the classes met per column."""
    classes = [cell_class(name, decimal_comma).alias(f"_k{i}") for i, name in enumerate(columns)]
    met = [F.expr(f"bit_or(_k{i}) AS all{i}") for i in range(len(columns))]
    return cells.select(*by, *classes).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *met)


def _only(classes: str, *kinds: str) -> str:
    """SQL that tells whether no other class than *kinds* was met."""
    return f"{classes} & {sum(bit for kind, bit in CLASSES.items() if kind not in kinds)} = 0"


def infer_types(classes: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, column, type, rows)``: the narrowest type that all cells of a column read as."""
    names = ", ".join(f"{_text(name)}, coalesce(all{i}, 0)" for i, name in enumerate(columns))
    rows = classes.select(*by, "rows", F.expr(f"stack({len(columns)}, {names}) AS (column, _all)"))
    alone = [f"WHEN {_only('_all', kind)} THEN '{kind}'" for kind in ("boolean", "date", "datetime")]
    kind = f"""CASE WHEN _all = 0 THEN 'text' WHEN {_only('_all', 'integer')} THEN 'integer'
        WHEN {_only('_all', 'integer', 'float')} THEN 'float' {' '.join(alone)} ELSE 'text' END"""
    return rows.select(*by, "column", F.expr(kind).alias("type"), "rows")


def typed_cell(cell: Column, kind: str, decimal_comma: bool = False) -> Column:
    """A text cell as *kind*; cells that do not fit become NULL."""
    cell = null_text(cell, kind)
    if kind == "integer":
        return F.trim(cell).try_cast("bigint")
    if kind == "float":
        return _point(cell, decimal_comma).try_cast("double")
    if kind == "boolean":
        return F.when(cell == "true", True).when(cell == "false", False)
    if kind == "date":
        return cell.try_cast("date")
    if kind == "datetime":
        from ..functions.times import from_us, iso_text_to_us

        return from_us(iso_text_to_us(cell))
    return cell


def typed(cells: DataFrame, types: dict[str, str], keep: Sequence[str] = (), decimal_comma: bool = False) -> DataFrame:
    """Text cells as typed columns."""
    return cells.select(*keep, *[typed_cell(F.col(n), k, decimal_comma).alias(n) for n, k in types.items()])


# -- reading --------------------------------------------------------------------------------

#: Why a row or cell is in :func:`misfits`.
UNCLOSED, UNEVEN, UNTYPED, RENAMED = "a quote is not closed", "not as many cells as columns", "the cell is no %s", "another header"


def header_of(spark: SparkSession, paths: str | Sequence[str], separator: str = ",") -> list[str]:
    """The column names of the first file."""
    return spark.read.options(header=True, sep=separator, quote='"', escape='"', multiLine=True).csv(paths).columns


def _parsed(spark: SparkSession, paths: str | Sequence[str], separator: str, names: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """``(source, no, record, open, head, cells)``: records with a struct of texts ``c0``, ``c1`` … and ``bad`` where they do not fit."""
    names = header_of(spark, paths, separator) if names is None else list(names)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField("bad", T.StringType())])
    # Empty and null-like texts are told apart later, so the parser keeps them as they are.
    options = {"sep": separator, "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "multiLine": "true", "columnNameOfCorruptRecord": "bad"}
    cells = F.from_csv("record", F.lit(schema.toDDL()), options)
    return read_records(spark, paths).withColumns({"cells": cells, "head": F.col("no") == 0}), names


def read_cells(spark: SparkSession, paths: str | Sequence[str], separator: str = ",", names: Sequence[str] | None = None, source: str = "source", pos: str = "pos") -> DataFrame:
    """CSV cells as texts plus *source* and *pos*, the row number in the file. Records may hold line breaks inside quotes.

    Records with missing cells get NULLs, cells beyond the columns are left out; :func:`misfits` lists both.
    """
    rows, names = _parsed(spark, paths, separator, names)
    cells = [F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)]
    return rows.filter("NOT head").select(*cells, F.col("source").alias(source), (F.col("no") - 1).alias(pos))


def misfits(spark: SparkSession, paths: str | Sequence[str], types: dict[str, str], separator: str = ",", decimal_comma: bool = False) -> DataFrame:
    """``(source, pos, column, cell, reason)``: what :func:`read_csv` with these *types* cannot hold, NULL columns for whole records."""
    names = list(types)
    rows, _ = _parsed(spark, paths, separator, names)
    none = F.lit(None).cast("string")
    tests = [F.when(F.col("open"), F.struct(none.alias("column"), F.col("record").alias("cell"), F.lit(UNCLOSED).alias("reason")))]
    uneven = ~F.col("open") & ~F.col("head") & F.col("cells.bad").isNotNull()
    tests.append(F.when(uneven, F.struct(none.alias("column"), F.col("record").alias("cell"), F.lit(UNEVEN).alias("reason"))))
    other = F.col("head") & ~F.forall(F.arrays_zip(F.array(*[F.col(f"cells.c{i}") for i in range(len(names))]).alias("a"), F.array(*map(F.lit, names)).alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    tests.append(F.when(other, F.struct(none.alias("column"), F.col("record").alias("cell"), F.lit(RENAMED).alias("reason"))))
    for i, (name, kind) in enumerate(types.items()):
        cell = F.col(f"cells.c{i}")
        wrong = ~F.col("head") & ~F.col("open") & null_text(cell, kind).isNotNull() & typed_cell(cell, kind, decimal_comma).isNull()
        tests.append(F.when(wrong, F.struct(F.lit(name).alias("column"), cell.alias("cell"), F.lit(UNTYPED % kind).alias("reason"))))
    found = rows.select("source", (F.col("no") - 1).alias("pos"), F.explode(F.array_compact(F.array(*tests))).alias("what"))
    return found.select("source", "pos", "what.*")


def inspect_csv(spark: SparkSession, path: str | Sequence[str], separator: str, decimal_comma: bool, names: Sequence[str] | None = None) -> tuple[dict[str, str], int]:
    """Column types of the CSV files under *path* (one dialect) and their number of rows."""
    names = header_of(spark, path, separator) if names is None else list(names)
    short = [f"c{i}" for i in range(len(names))]
    cells = read_cells(spark, path, separator, short)
    rows = {row.column: row for row in infer_types(cell_classes(cells, short, (), decimal_comma), short).collect()}  # one row per column
    return {name: rows[c].type for name, c in zip(names, short)}, rows[short[0]].rows if short else 0


def read_csv(
    spark: SparkSession, path: str | Sequence[str], separator: str = ",", decimal_comma: bool = False, types: dict[str, str] | None = None,
    source: str = "source", pos: str = "pos",
) -> DataFrame:
    """Typed CSV rows plus *source* and *pos*; types are inferred over all rows unless given."""
    if types is None:
        types, _ = inspect_csv(spark, path, separator, decimal_comma)
    names = {name: f"c{i}" for i, name in enumerate(types)}
    cells = read_cells(spark, path, separator, list(names.values()))
    return cells.select(F.col("source").alias(source), F.col("pos").alias(pos), *[typed_cell(F.col(c), types[name], decimal_comma).alias(name) for name, c in names.items()])


def csv_scans(spark: SparkSession, files: DataFrame) -> tuple[list[tuple[list[str], str, bool, dict[str, str]]], dict[str, str]]:
    """CSV files of *files* (``path``) by dialect and header, as ``(paths, separator, decimal_comma, types)``, and why others are no CSV."""
    rows = file_dialects(spark, files).collect()  # one row per file
    left = {row.source: row.error for row in rows if row.error}
    groups: dict[tuple, list[str]] = {}
    for row in rows:
        if not row.error:
            groups.setdefault((row.separator, row.decimal_comma), []).append(row.source)
    scans = []
    for (separator, comma), paths in sorted(groups.items()):
        same: dict[str, list[str]] = {}
        for row in read_records(spark, paths).filter("no = 0 AND NOT open").select("source", "record").collect():  # one row per file
            same.setdefault(row.record, []).append(row.source)
        for record in sorted(same):
            one = sorted(same[record])
            names = header_of(spark, one[0], separator)
            scans.append((one, separator, comma, inspect_csv(spark, one, separator, comma, names)[0]))
        left.update({path: UNCLOSED for path in set(paths).difference(*same.values())})
    return scans, left


def read_csv_folder(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All CSV files of *files* (``path``), whatever their dialects, as one frame of typed rows, and ``(source, reason)`` of those left out.

    Files of one dialect and header are one scan. Columns of one name are widened over the scans (integer, float, text);
    a column that a file does not have is NULL in its rows.
    """
    scans, left = csv_scans(spark, files)
    types: dict[str, str] = {}
    for *_, mine in scans:
        for name, kind in mine.items():
            types[name] = wider(types.get(name, kind), kind)
    frames = [read_csv(spark, paths, separator, comma, {name: types[name] for name in mine}) for paths, separator, comma, mine in scans]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("pos", T.LongType()), *[T.StructField(n, spark_type(k)) for n, k in types.items()]])
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else spark.createDataFrame([], schema)
    return whole, spark.createDataFrame(list(left.items()), "source string, reason string")


def wider(one: str, other: str) -> str:
    """The type that holds the cells of both."""
    if one == other:
        return one
    return "float" if {one, other} == {"integer", "float"} else "text"


def spark_type(kind: str) -> T.DataType:
    return {
        "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(),
        "date": T.DateType(), "datetime": T.TimestampNTZType(),
    }.get(kind, T.StringType())

"""Rows that fail to parse: split delimited and fixed-width lines into cells, validate the cells against a
rule table, and set failing lines apart with the first reason that applies.

The cells go through a long form (line, column, value); a broadcast rule table of fixed size says what each
column must look like, only failing cells survive the validation, so what is aggregated per line (and the only
thing shuffled for the error report) is as large as the errors, not as the input. Clean rows are the lines
without an error, found by an anti-join.

Defined results: a NULL line counts as an empty line (``columns``); a line of any file other than
``stations.txt``, a NULL file name included, is read as CSV; repeated lines give the same error once; lines with
a NULL id are told apart by their content; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("station_id", "date", "element", "value", "mflag", "qflag", "sflag", "obs_time")
#: column name, first character (from 1), number of characters
FIXED_COLUMNS = (("station_id", 1, 11), ("lat", 12, 9), ("lon", 21, 10), ("elev", 31, 7), ("name", 39, 2_000_000_000))
FIXED_MIN_CHARS = 30
DECIMAL = r"^-?[0-9]+(\.[0-9]+)?$"

#: kind of file, column, priority, reason, pattern the cell must match, trim spaces first, must be a real day
RULES = (
    ("csv", "#quoting", 1, "quoting", "^ok$", False, False),
    ("csv", "#columns", 2, "columns", f"^{len(CSV_COLUMNS)}$", False, False),
    ("csv", "date", 3, "date", "^[0-9]{8}$", False, True),
    ("csv", "value", 4, "value", DECIMAL, True, False),
    ("fixed", "#columns", 1, "columns", "^ok$", False, False),
    ("fixed", "lat", 2, "coordinates", DECIMAL, True, False),
    ("fixed", "lon", 2, "coordinates", DECIMAL, True, False),
    ("fixed", "elev", 3, "elev", rf"^$|{DECIMAL}", True, False),
)
#: ends a field inside a line; the data's own U+0001 is doubled with U+0002 meanwhile, so nothing in it can look like this
_MARK, _KEPT, _SEP = "\u0001", "\u0001\u0002", "\u0001\u0003"


def _quoting_ok(parts: Column) -> Column:
    """Whether the pieces between double quotes form well-quoted fields; odd pieces lie inside quotes."""
    n = F.size(parts)

    def bad(s: Column, i: Column) -> Column:
        opens, closes, text = i < n - 1, i > 0, s != ""
        return (i % 2 == 0) & text & ((opens & ~s.endswith(",")) | (closes & ~s.startswith(",")))

    return (n % 2 == 1) & ~F.exists(F.transform(parts, bad), lambda x: x)


def csv_fields(line: Column) -> Column:
    """Struct of ``fields``, those of one CSV line without their quotes, and ``sound``, whether its quoting is."""
    def quoted(parts: Column) -> Column:
        n = F.size(parts)

        def piece(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 1, s).when((s == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(F.replace(s, F.lit(","), F.lit(_SEP)))

        return F.struct(F.split(F.array_join(F.transform(parts, piece), ""), _SEP, -1).alias("fields"), _quoting_ok(parts).alias("sound"))

    # the one-element transform binds the pieces to a variable, so they are made once and not for each of them again
    bound = F.get(F.transform(F.array(F.split(line, '"', -1)), quoted), F.lit(0))
    return F.when(~line.contains('"'), F.struct(F.split(line, ",", -1).alias("fields"), F.lit(True).alias("sound"))).otherwise(bound)


def split_lines(df: DataFrame, line_id: str = "line_id", file_name: str = "file_name", line: str = "line") -> DataFrame:
    """Columns ``line_id, rid, kind, fields ARRAY<STRING>, shape ARRAY<STRUCT<column, value>>``.

    ``shape`` holds the checks on the whole line as if they were cells.
    """
    d = df.select(F.col(line_id).alias("line_id"), F.xxhash64(F.col(line_id), F.col(file_name), F.col(line)).alias("rid"),
                  F.when(F.lower(F.trim(F.col(file_name))) == "stations.txt", F.lit("fixed")).otherwise(F.lit("csv")).alias("kind"),
                  F.coalesce(F.col(line), F.lit("")).alias("text"))
    fixed = F.struct(F.array(*[F.substring("text", a, n) for _, a, n in FIXED_COLUMNS]).alias("fields"), F.lit(True).alias("sound"))
    marked = F.col("text").contains(_MARK)
    safe = F.when(marked, F.replace("text", F.lit(_MARK), F.lit(_KEPT))).otherwise(F.col("text"))
    d = d.withColumn("c", F.when(F.col("kind") == "csv", csv_fields(safe)).otherwise(fixed))
    back = F.transform("c.fields", lambda x: F.replace(x, F.lit(_KEPT), F.lit(_MARK)))
    d = d.withColumn("c", F.when(marked & (F.col("kind") == "csv"), F.struct(back.alias("fields"), F.col("c.sound").alias("sound"))).otherwise(F.col("c")))
    d = d.select("line_id", "rid", "kind", "text", "c.fields", "c.sound")
    pair = lambda c, v: F.struct(F.lit(c).alias("column"), v.alias("value"))
    shape = F.when(F.col("kind") == "csv", F.array(pair("#quoting", F.when(F.col("sound"), F.lit("ok")).otherwise(F.lit("bad"))), pair("#columns", F.size("fields").cast("string")))).otherwise(
        F.array(pair("#columns", F.when(F.length("text") >= FIXED_MIN_CHARS, F.lit("ok")).otherwise(F.lit("short")))))
    return d.select("line_id", "rid", "kind", "fields", shape.alias("shape"))


def explode_cells(parsed: DataFrame, columns: set[str] | None = None) -> DataFrame:
    """Long form: one row per line and cell (``line_id, rid, kind, column, value``); ``columns`` prunes before the explode."""
    def named(names):
        return F.array(*[F.struct(F.lit(c).alias("column"), F.get("fields", F.lit(i)).alias("value")) for i, c in enumerate(names) if columns is None or c in columns])

    cells = F.concat("shape", F.when(F.col("kind") == "csv", named(CSV_COLUMNS)).otherwise(named([c for c, _, _ in FIXED_COLUMNS])))
    return parsed.select("line_id", "rid", "kind", F.explode(cells).alias("cell")).select("line_id", "rid", "kind", "cell.column", "cell.value").filter(F.col("value").isNotNull())


def parse_errors(df: DataFrame, rules=RULES, **names: str) -> DataFrame:
    """``line_id, rid, reason, reasons``: one row per failing line; ``reason`` is the first that applies."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(rules), "kind string, column string, priority int, reason string, pattern string, trimmed boolean, real_day boolean")
    cells = explode_cells(split_lines(df, **names), {c for _, c, *_ in rules})
    j = cells.join(F.broadcast(table), ["kind", "column"])
    v = F.when(F.col("trimmed"), F.trim("value")).otherwise(F.col("value"))
    right = F.regexp(v, F.col("pattern")) & (~F.col("real_day") | F.try_to_timestamp(F.col("value"), F.lit("yyyyMMdd")).isNotNull())
    return (j.filter(~F.coalesce(right, F.lit(False))).groupBy("line_id", "rid")
            .agg(F.min_by("reason", "priority").alias("reason"), F.transform(F.array_sort(F.collect_set(F.struct("priority", "reason"))), lambda x: x["reason"]).alias("reasons")))


def parse_clean(df: DataFrame, rules=RULES, **names: str) -> DataFrame:
    """Typed rows of the lines without an error, both kinds of file in one schema."""
    errors = parse_errors(df, rules, **names).select(F.col("line_id").alias("e_id"), F.col("rid").alias("e_rid"))
    p = split_lines(df, **names)
    ok = p.join(errors, (p.rid == errors.e_rid) & p.line_id.eqNullSafe(errors.e_id), "left_anti")
    csv, f = F.col("kind") == "csv", lambda i: F.get("fields", F.lit(i))
    num = lambda c: F.trim(c).try_cast("double")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    cols = [F.col("line_id"), F.col("kind"), F.trim(f(0)).alias("station_id")]
    cols += [F.when(csv, F.try_to_timestamp(f(1), F.lit("yyyyMMdd")).cast("date")).alias("date"), F.when(csv, f(2)).alias("element"), F.when(csv, num(f(3))).alias("value")]
    cols += [F.when(csv, text(f(i))).alias(CSV_COLUMNS[i]) for i in range(4, 8)]
    cols += [F.when(~csv, num(f(1))).alias("lat"), F.when(~csv, num(f(2))).alias("lon"), F.when(~csv, num(f(3))).alias("elev"), F.when(~csv, text(f(4))).alias("name")]
    return ok.select(*cols)

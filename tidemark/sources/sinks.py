"""Writers: manifests, logs, tables of text, subtitle events, numbered outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, MapType, StructType


def cell(df: DataFrame, column: str) -> Column:
    """A value as a manifest's text: null empty, true/false, numbers to three places without trailing zeros, nested as JSON."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, ArrayType | MapType | StructType):
        out = F.to_json(x)
    elif isinstance(kind, DoubleType | FloatType):
        out = F.regexp_replace(F.format_string("%.3f", F.round(x.cast("double"), 3)), r"0{1,2}$", "")
        out = F.when(x.isNotNull(), out)
    elif isinstance(kind, BooleanType):
        out = F.when(x, "true").when(~x, "false")
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit(""))


def manifest(df: DataFrame, first: list[str]) -> DataFrame:
    """All columns as text, the named ones first, the others in the order of their names."""
    order = [*first, *sorted(set(df.columns) - set(first))]
    return df.select(*(cell(df, c).alias(c) for c in order))


def write_manifest(df: DataFrame, path: str, first: list[str], order: list[Column]) -> None:
    """The ordered rows as CSV and as JSON; Spark's committer makes each appear as a whole."""
    rows = df.orderBy(*order)
    manifest(rows, first).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def append_errors(df: DataFrame, path: str, trace: str = "traceback", most: int = 4000) -> None:
    """Append error rows as JSON lines, with the last ``most`` characters of their traces."""
    df.withColumn(trace, F.when(F.length(trace) > most, F.right(trace, F.lit(most))).otherwise(F.col(trace))).write.mode("append").json(path)


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One text column ``line``: columns padded to their widths, longer values cut."""
    parts = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ") for c, n in widths.items()]
    return df.select(F.rtrim(F.concat_ws(" ", *parts)).alias("line"))


def next_version(names: DataFrame, stem: str, column: str = "name") -> int:
    """One more than the largest number of ``stem``_vNN, 1 where there is none."""
    n = F.regexp_extract(column, rf"^{stem}_v(\d+)", 1)
    return (names.select(F.max(F.when(n != "", n.cast("int")))).first()[0] or 0) + 1


def subtitle_lines(df: DataFrame, start: Column, end: Column, text: Column) -> DataFrame:
    """Rows as subtitle events."""
    from tidemark.functions.text import subtitle_time

    return df.select(F.concat(F.lit("Dialogue: 0,"), subtitle_time(start), F.lit(","), subtitle_time(end), F.lit(",Main,,0,0,0,,"), text).alias("line"))


#: Rows of a table of a report at most.
REPORT_ROWS = 1000


def markdown(counts: dict[str, DataFrame]) -> str:
    """A report of small tables as text on the driver; one of over REPORT_ROWS rows is no report, and fails."""
    out = []
    for title, df in counts.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{title} has more than {REPORT_ROWS} rows")
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)

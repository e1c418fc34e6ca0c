"""Readers of the files that pipelines leave: stage results, labels, decisions, logs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tidemark.operators.changes import DECISIONS


def stage(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON rows by a fixed schema: unknown keys are dropped, missing ones are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def or_empty(spark: SparkSession, path: str, schema: str | StructType, kind: str = "json") -> DataFrame:
    """The rows at ``path``, none where it doesn't exist."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], spark.createDataFrame([], schema).schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def labels(spark: SparkSession, path: str, vocabulary: list[str], key: str = "play_id", label: str = "label") -> DataFrame:
    """A CSV of labels: trimmed, of the vocabulary only, and of several rows of a key the last one in the file."""
    rows = spark.read.option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.select(F.trim(key).alias(key), F.trim(label).alias(label), "_f", "_n").filter(F.col(label).isin(vocabulary) & (F.col(key) != ""))
    return rows.groupBy(key).agg(F.max_by(label, F.struct("_f", "_n")).alias(label))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions from one object: values are texts or objects with a decision and a note; others are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("play_id", "v"))
    inner = F.from_json("v", "decision string, note string")
    text = F.lower(F.trim(F.coalesce(inner["decision"], "v")))
    names = F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv))
    return raw.select("play_id", names[text].alias("decision"), inner["note"].alias("note")).filter("decision is not null")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed boxes: those with four numbers and a time."""
    rows = spark.read.schema("play_id string, t double, box array<double>").option("multiLine", True).json(path)
    return rows.filter((F.size("box") == 4) & F.col("t").isNotNull() & ~F.exists("box", lambda x: x.isNull()))


def crops(spark: SparkSession, path: str) -> DataFrame:
    """Crop frames of either shape, {frames: [{t, crop, player_x}]} or {t: [], crop: [], player_x: []}, as rows."""
    shape = "clip_id string, frames array<struct<t double, crop array<double>, player_x double>>, t array<double>, crop array<array<double>>, player_x array<double>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path)
    one = rows.select("clip_id", F.explode("frames").alias("f"))
    two = rows.filter("frames is null").select("clip_id", F.explode(F.arrays_zip("t", "crop", "player_x")).alias("f"))
    return one.unionByName(two).select("clip_id", "f.*")


def files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Path, size and time of files below ``path`` by extension; hidden ones are left out, each path comes once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return found.filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(extensions) & ~name.startswith(".")).dropDuplicates(["path"])


def frames_in(df: DataFrame, at: str, start: float, end: float, fps: float) -> DataFrame:
    """Rows of [start, end) thinned to the first one of each 1/fps."""
    cell = F.floor((F.col(at) - start) * fps)
    kept = df.filter((F.col(at) >= start) & (F.col(at) < end))
    first = kept.groupBy(cell.alias("_c")).agg(F.min(at).alias("_a"))
    return kept.withColumn("_c", cell).join(first, "_c").filter(F.col(at) == F.col("_a")).drop("_c", "_a")


def log_scan(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """All matches of a pattern's first group in text logs, as numbers, by file and place."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("place", "x"))
    return rows.select("file", "place", F.col("x").cast("double").alias("x"))

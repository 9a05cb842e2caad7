"""Manifests as text tables: CSV with any header, JSON in envelopes, three-row landmark CSV, file listings; and their sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean

ENVELOPES = ("rows", "records", "candidates", "predictions", "items", "outputs", "images", "results", "detections")


def read_csv(spark: SparkSession, path: str | list[str], lines_in_cells: bool = False) -> DataFrame:
    """All columns as text, names normalised, a byte-order mark dropped. Files with line ends inside of cells can't be split among tasks; say so."""
    raw = spark.read.option("header", True).option("multiLine", lines_in_cells).option("escape", '"').csv(path)
    return raw.toDF(*clean.header_names(raw))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if it has all the columns; the error names those that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_json_rows(spark: SparkSession, path: str, one_value: bool = True) -> DataFrame:
    """Rows of a JSON list, or of the first envelope that a JSON object has. one_value: a file is one JSON value; else each line is one, and files are split."""
    raw = spark.read.option("multiLine", one_value).json(path)
    name = next((e for e in ENVELOPES if e in raw.columns), None)
    return raw.select(F.explode(name).alias("row")).select("row.*") if name else raw


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header rows scorer, bodyparts and coords, as (image, bodypart, coord, value)."""
    raw = spark.read.option("header", False).csv(path)
    first = raw.columns[0]
    heads = {r[first]: r for r in raw.where(F.col(first).isin("bodyparts", "coords")).limit(2).collect()}
    body = raw.where(~F.col(first).isin("scorer", "bodyparts", "coords"))
    cells = [F.struct(F.lit(heads["bodyparts"][c]).alias("bodypart"), F.lit(heads["coords"][c]).alias("coord"), F.col(c).try_cast("double").alias("value")) for c in raw.columns if heads["coords"][c] in ("x", "y", "likelihood")]
    return body.select(F.col(first).alias("image"), F.explode(F.array(*cells)).alias("c")).select("image", "c.*")


def list_files(spark: SparkSession, path: str, extensions: list[str], modified_after: str | None = None) -> DataFrame:
    """Path, bytes and time of files by extension, in order of the lower-cased path. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    return reader.load(path).select("path", "length", "modificationTime").withColumn("extension", ending).where(ending.isin(*extensions)).orderBy(F.lower("path"))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in the order first seen, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns named, others dropped, missing ones blank."""
    df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns)).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(sorted(df.columns)).write.json(path)


def append_new(df: DataFrame, table: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the table doesn't have yet, each key once: insert or ignore."""
    fresh = df.dropDuplicates([key])
    return fresh if table is None else fresh.join(table.select(key), key, "left_anti")


def carried(df: DataFrame, prefix: str = "src_", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of an earlier step under a prefix, so that this step's own names are free."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep and not c.startswith(prefix)})


def wide_landmarks(df: DataFrame, bodyparts: list[str], coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Long landmarks (image, bodypart, coord, value) as one row per image; parts and coordinates are named, so nothing has to be counted first."""
    cells = [F.max(F.when((F.col("bodypart") == b) & (F.col("coord") == c), F.col("value"))).alias(f"{b}_{c}") for b in bodyparts for c in coords]
    return df.groupBy("image").agg(*cells)


def snapshot(df: DataFrame, folder: str, version: int) -> None:
    """A table as it is now, under a version of its own; a version that exists is never overwritten."""
    df.write.mode("error").parquet(f"{folder}/version={version}")


def restore(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table of a version, or of the newest; only that version's files are read."""
    versions = spark.read.parquet(folder)
    wanted = version if version is not None else versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == wanted).drop("version")


def write_by_name(df: DataFrame, path: str, name: str) -> None:
    """A folder for each name: rows of one name are brought together first, so a name has few files."""
    df.repartition(name).write.partitionBy(name).json(path)

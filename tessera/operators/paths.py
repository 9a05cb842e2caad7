"""Paths of records resolved against an inventory of files: the first candidate that exists wins, and which one it was is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.clean import blank_to_null
from tessera.operators.spread import join_counted

#: What an absolute path begins with: a slash, a share, or a drive.
ABSOLUTE = r"^([/\\]|[A-Za-z]:[/\\])"


def joined(root: Column, path: Column) -> Column:
    """A path under a folder, with one slash between."""
    return F.concat(F.regexp_replace(root, r"[/\\]+$", ""), F.lit("/"), path)


def tidy(path: Column) -> Column:
    """Slashes one way and single (a share keeps its two), and no dot as a part of its own."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<!^)/+", "/")
    return F.when(path.contains("\\") | path.contains("//") | path.contains("/./"), F.regexp_replace(slashes, r"(?<=/)(\./)+", "")).otherwise(path)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def manifest_candidates(path: Column, project: Column, folder: Column) -> list[tuple[str, Column]]:
    """Where a manifest's path may lie: itself if absolute, else under the project and then the manifest's own folder."""
    whole = path.rlike(ABSOLUTE)
    return [("absolute", F.when(whole, path)), ("relative_to_project_root", F.when(~whole, joined(project, path))), ("relative_to_manifest_dir", F.when(~whole, joined(folder, path)))]


def crop_candidates(path: Column, project: Column, output: Column) -> list[tuple[str, Column]]:
    """Where a crop may lie: where it says, under the project, under the output folder, or by its name among the crops."""
    named = joined(output, F.concat(F.lit("crops/"), name_of(path)))
    return [("as_is", path), ("project", joined(project, path)), ("output", joined(output, path)), ("crops", named)]


def resolved(rows: DataFrame, row_id: str, path: str, candidates: list[tuple[str, Column]], files: DataFrame) -> DataFrame:
    """rows with resolved, exists and source; files: the inventory (path), read as a table and never asked one by one.

    Candidates (name, expression; null is none) are tried in their order. Without a file the first one stands, its source marked _missing;
    a blank path gives blank. Paths are compared by tidy, letters as they are. A candidate that many rows share is met where those rows are.
    """
    there = files.select(tidy(F.col("path")).alias("__c")).where("__c is not null").distinct().withColumn("__there", F.lit(True))
    each = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(k).alias("__n"), F.lit(name).alias("__source"), c.alias("__path"), tidy(c).alias("__c"))) for k, (name, c) in enumerate(candidates))))
    filled = rows.where(blank_to_null(F.col(path)).isNotNull()).withColumn(path, F.trim(path))
    tried = join_counted(filled.select(row_id, F.inline(each)), there, ["__c"], [row_id])
    best = tried.groupBy(row_id).agg(F.min(F.struct(F.col("__there").isNull().alias("missing"), "__n", "__path", "__source")).alias("b"))
    source = F.when(F.col("b.missing"), F.concat("b.__source", F.lit("_missing"))).otherwise(F.col("b.__source"))
    found = best.select(row_id, F.col("b.__path").alias("resolved"), (~F.col("b.missing")).alias("exists"), source.alias("source"))
    out = rows.join(found, row_id, "left")
    return out.withColumns({"resolved": F.coalesce("resolved", F.lit("")), "exists": F.coalesce("exists", F.lit(False)), "source": F.coalesce("source", F.lit("blank"))})


def shown_per_profile(rows: DataFrame, profile: str, order: list, most: int = 300) -> DataFrame:
    """The first `most` rows of each profile whose file exists, numbered, and which is the hero: the first of them."""
    place = F.row_number().over(W.partitionBy(profile).orderBy(*order))
    few = rows.where("exists").withColumn("place", place).where(F.col("place") <= most)
    return few.withColumn("hero", F.col("place") == 1)

"""What the corpus operators share: tables in the shared folder, numbering without hot tasks, column hygiene."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows that one task numbers or sums in one go.
ROWS_PER_BUCKET = 16_384
#: A key is heavy if more than one row in so many has it.
HEAVY_SHARE = 1000

_cleaners: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it isn't, only a local master gets a folder of its own; on a cluster a machine-local
    folder would lose rows, so that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    if path not in _cleaners:
        _cleaners.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._gateway is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended first; the folder then stays for the cluster's own cleaning
        return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and no executor's loss undoes it."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size has a bound; the bound is checked, never enforced by cutting."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names near the wanted ones that no column of df has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc_bucket(key: Column, buckets: int, null: int = 0) -> Column:
    """crc32 of the key as text, modulo buckets; a null key gets the bucket given."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % buckets, F.lit(null))


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], n: str, spread: list[str]) -> DataFrame:
    """rows left-joined to a staged table with one row per key, whose column n tells how many rows have the key.

    Keys of more than one row in a thousand are a thousand at most, whatever the input: they are broadcast, and their rows stay
    where they are. All other keys are shuffled; rows already matched and those with a null key are spread by `spread`.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    limit = (total or 0) // HEAVY_SHARE
    values = [c for c in table.columns if c not in on and c != n]
    if (most or 0) <= limit:
        return rows.join(table.drop(n), on, "left")
    salt, mark, *names = free_names(rows, "salt", "heavy", *(f"heavy_{c}" for c in values), *(f"key_{c}" for c in on), *(f"late_{c}" for c in values))
    early, keys, late = names[: len(values)], names[len(values) : len(values) + len(on)], names[len(values) + len(on) :]
    heavy = table.where(F.col(n) > limit).select(*on, *(F.col(c).alias(e) for c, e in zip(values, early, strict=True)), F.lit(True).alias(mark))
    first = rows.join(F.broadcast(heavy), on, "left")  # at most HEAVY_SHARE rows
    alone = F.col(mark).isNotNull()
    for c in on:
        alone = alone | F.col(c).isNull()
    keyed = first.withColumns({k: F.when(~alone, F.col(c)) for k, c in zip(keys, on, strict=True)} | {salt: F.when(alone, F.pmod(F.xxhash64(*spread), F.lit(HEAVY_SHARE))).otherwise(F.lit(-1).cast("long"))})
    rest = table.where(F.col(n) <= limit).select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), *(F.col(c).alias(e) for c, e in zip(values, late, strict=True)), F.lit(-1).cast("long").alias(salt))
    return keyed.join(rest, [*keys, salt], "left").select(*rows.columns, *(F.coalesce(a, b).alias(c) for a, b, c in zip(early, late, values, strict=True)))


def running_offsets(df: DataFrame, group: list[str], bucket: str, amount: Column, name: str) -> DataFrame:
    """For each bucket of each group, the amount in the group's earlier buckets.

    Only sums per bucket meet in one task, so a group with a third of all rows costs no more than its bucket count.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias(name))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(name).over(before), F.lit(0)).cast("long"))


def numbered(df: DataFrame, group: list[str], spread: Column, order: list, out: str, total: int) -> DataFrame:
    """A gapless number from 0 in each group, dealt over buckets so that hot groups are shared by many tasks.

    df has to be a staged table: it is read twice. spread decides the bucket, order the place inside it.
    """
    bucket, base = free_names(df, "bucket", "base")
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    spreaded = df.withColumn(bucket, F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    offsets = running_offsets(spreaded, group, bucket, F.lit(1), base)
    place = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)) - 1
    return spreaded.join(offsets, [*group, bucket]).withColumn(out, (F.col(base) + place).cast("long")).drop(bucket, base)

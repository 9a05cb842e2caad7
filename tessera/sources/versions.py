"""Versions of a table in a shared folder: data first, its manifest last, so a version is there as a whole or not at all.

A manifest names the data's folder and holds its row count and a digest, taken from what was written. It is created and never overwritten, so of
two writers of one version the second fails. Reading takes the newest version whose data agrees with its manifest: one that was torn while
written, or whose files were lost or changed later, is passed over. Restoring and undoing write a manifest of their own that names
older data, so history is only ever added to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


@dataclass(frozen=True)
class Manifest:
    version: int
    data: str
    rows: int
    digest: str
    schema: str
    note: str
    parent: int | None  # the version that undoing this one goes back to


class VersionExists(RuntimeError):
    """Another writer was first."""


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum over their hashes that doesn't depend on their order."""
    columns = [F.to_json(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in df.columns]
    nulls = F.concat(F.lit(""), *(F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns))
    total = F.sum(F.xxhash64(nulls, *columns).cast("decimal(38,0)"))
    rows, number = df.agg(F.count("*"), total).first()
    return rows, str(number or 0)


class Versions:
    """The versions under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        where = self._path("manifests")
        self._files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _write(self, manifest: Manifest) -> None:
        where = self._path(f"manifests/{manifest.version:08d}.json")
        try:
            out = self._files.create(where, False)
        except Exception as e:
            if self._files.exists(where):
                raise VersionExists(str(manifest.version)) from e
            raise
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()

    def _names(self) -> list[str]:
        where = self._path("manifests")
        return sorted(f.getPath().getName() for f in self._files.listStatus(where)) if self._files.exists(where) else []

    def manifests(self) -> list[Manifest]:
        """All that can be read, oldest first; half-written ones are passed over."""
        out = []
        for name in self._names():
            text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{name}").first()
            try:
                out.append(Manifest(**json.loads(text[0])))
            except (ValueError, TypeError):
                continue
        return out

    def data(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(manifest.schema))).parquet(f"{self.folder}/{manifest.data}")

    def whole(self, manifest: Manifest) -> bool:
        """Whether the data is what was written."""
        if not self._files.exists(self._path(manifest.data)):
            return False
        try:
            return digest(self.data(manifest)) == (manifest.rows, manifest.digest)
        except Exception as e:  # a file that ends early or is no data at all
            if "FAILED_READ_FILE" in str(e) or "is not a Parquet file" in str(e) or "FileNotFound" in str(e) or "CANNOT_READ" in str(e):
                return False
            raise

    def current(self) -> Manifest | None:
        return next((m for m in reversed(self.manifests()) if self.whole(m)), None)

    def _next(self) -> int:
        numbers = [int(n.removesuffix(".json")) for n in self._names()]
        return max(numbers, default=0) + 1

    def commit(self, df: DataFrame, note: str = "", version: int | None = None) -> Manifest:
        """A new version. version: the number expected, an error if another writer has taken it."""
        before = self.current()
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        manifest = Manifest(version or self._next(), name, *digest(written), df.schema.json(), note, before.version if before else None)
        self._write(manifest)
        return manifest

    def read(self, version: int | None = None) -> DataFrame:
        """The newest whole version, or the one asked for; an error if that one isn't whole."""
        manifest = self.current() if version is None else next((m for m in self.manifests() if m.version == version and self.whole(m)), None)
        if manifest is None:
            raise ValueError("no whole version" if version is None else f"version {version} isn't whole")
        return self.data(manifest)

    def restore(self, version: int, note: str = "") -> Manifest:
        """A new version with an older one's data."""
        old = next((m for m in self.manifests() if m.version == version and self.whole(m)), None)
        if old is None:
            raise ValueError(f"version {version} isn't whole")
        new = replace(old, version=self._next(), note=note or f"restore {version}", parent=old.parent)
        self._write(new)
        return new

    def undo(self) -> Manifest:
        """A new version with what was there before the current one; undoing again goes further back."""
        now = self.current()
        if now is None or now.parent is None:
            raise ValueError("nothing to undo")
        return self.restore(now.parent, f"undo {now.version}")

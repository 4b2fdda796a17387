"""Small keyed tables on Parquet: append if absent, upsert, delete."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import upsert


class ConcurrentChange(RuntimeError):
    """Another writer has changed the table since it was read; read again and repeat."""


class KeyedTable:
    """Versions of a table in one folder; the newest is the table.

    A change writes a whole new version beside the last one and is visible
    once its marker is there, so readers never see half a change.  A marker is
    renamed to its version's number, which succeeds once: of two changes made
    from one version the later raises ConcurrentChange and nothing is lost.
    A marker also holds the last batch that each stream has written, so a batch
    that is repeated is known.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, str | None]:
        """Number and folder of the newest version; (0, None) of an empty table."""
        fs = self._files()
        if not fs.exists(self._at()):
            return 0, None
        names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(self._at())) if n.endswith(".version"))
        if not names:
            return 0, None
        return int(names[-1][:10]), self._marker(names[-1])[0]

    def _marker(self, name: str) -> list[str]:
        """Folder of a version and, as JSON, the last batch of each stream."""
        return [*(r["value"] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()), ""][0].split("\n")

    def batches(self) -> dict[str, int]:
        """The last batch of each stream that the table holds."""
        n, folder = self._newest()
        told = self._marker(f"{n:010d}.version")[1:] if folder else []
        return json.loads(told[0]) if told else {}

    def _rows(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def read(self) -> DataFrame:
        return self._rows(self._newest()[1])

    def write(self, rows: DataFrame, after: int | None = None, batches: dict[str, int] | None = None) -> None:
        """rows as the version that follows number after; without it, the newest.  batches: as the method, if they change."""
        n = (self._newest()[0] if after is None else after) + 1
        told = json.dumps(self.batches() if batches is None else batches)
        folder = f"rows-{n:010d}-{uuid.uuid4().hex[:8]}"
        rows.select(*self._rows(None).columns).write.parquet(f"{self.path}/{folder}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        out = self._files().create(self._at(f"{folder}.marker"))
        out.write(bytearray(f"{folder}\n{told}".encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._at(f"{folder}.marker"), self._at(f"{n:010d}.version"), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise ConcurrentChange(f"version {n} of {self.path} exists") from e

    def append_absent(self, rows: DataFrame, order: str) -> None:
        """First writer wins, in the table and among the rows."""
        n, folder = self._newest()
        held = self._rows(folder)
        first = rows.groupBy(*self.key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        self.write(held.unionByName(first.join(held.select(*self.key), self.key, "left_anti").select(*held.columns)), n)

    def upsert(self, rows: DataFrame, order: str, keep: tuple[str, ...] = ()) -> None:
        n, folder = self._newest()
        self.write(upsert(self._rows(folder), rows, self.key, order, keep), n)

    def delete(self, keys: DataFrame) -> None:
        n, folder = self._newest()
        self.write(self._rows(folder).join(keys.select(*self.key), self.key, "left_anti"), n)


def unexpired(rows: DataFrame, now, column: str = "expires_at") -> DataFrame:
    """Cache rows that still hold."""
    return rows.filter(F.col(column) >= now)


def cache_stats(rows: DataFrame, now, column: str = "expires_at") -> DataFrame:
    return rows.agg(F.count_if(F.col(column) >= now).alias("valid"), F.count_if(F.col(column) < now).alias("expired"))

"""Versioned tables of Parquet files: upserts, patches and deletes as optimistic commits (SK1-SK4, X31, ST7).

A table is a folder: ``data`` holds immutable folders of Parquet files, ``versions`` one small manifest per version, which names the
folder of each bucket (a hash of the key). A write reads the buckets of its keys only, writes them anew and commits by creating the
next manifest, which fails if another writer was faster. Then the write looks whether that one changed its buckets: if not, it
commits on top, otherwise it computes these buckets again. Readers see whole versions, older ones too.

A writer may name itself and number its batches (as ``foreachBatch`` does): the manifest keeps the last number of each writer, so
that a batch which comes again changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class Manifest:
    version: int
    schema: str
    keys: list[str]
    buckets: int
    #: bucket number (as text) to the folder that holds it
    folders: dict[str, str] = field(default_factory=dict)
    #: writer to its last batch
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, retries: int = 50):
        self.spark, self.path, self.retries = spark, path.rstrip("/"), retries
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files
    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _create(self, name: str, text: str) -> None:
        """Create a file as a whole, or raise Conflict if it exists."""
        target = self._at("versions", name)
        fs = target.getFileSystem(self.conf)
        if fs.getUri().getScheme() == "file":
            # A link to a finished file fails where the name is taken; the local file system of Hadoop only looks first.
            local = target.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            temporary = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, local)
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                os.remove(temporary)
            return
        try:
            out = fs.create(target, False)
        except Exception as e:
            if fs.exists(target):
                raise Conflict(name) from e
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()

    def versions(self) -> list[int]:
        folder = self._at("versions")
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        v = known[-1] if version is None else version
        text = self.spark.read.text(self._at("versions", f"{v:020d}.json").toString(), wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, m: Manifest) -> None:
        self._create(f"{m.version:020d}.json", json.dumps(asdict(m), sort_keys=True))

    # reads
    def _rows(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromDDL(m.schema)
        wanted = [b for b in m.folders if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{m.folders[b]}/bucket__={b}" for b in sorted(wanted, key=int)))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last one."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"no version {version} of {self.path}" if version is not None else f"no table in {self.path}")
        return self._rows(m)

    # writes
    def create(self, schema: str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """An empty table; an existing one stays as it is."""
        if not self.versions():
            try:
                self._commit(Manifest(0, schema, keys, buckets))
            except Conflict:
                pass
        return self

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.hash(*m.keys), F.lit(m.buckets))

    def _write(self, change: Callable[[Manifest], tuple[list[str] | None, Callable[[DataFrame], DataFrame]]], writer: str | None, batch: int | None) -> int:
        """Commit a change: which buckets it touches, and what it makes of their rows. Returns the version."""
        done: dict[str, str] = {}
        base: Manifest | None = None
        for _ in range(self.retries):
            m = self.manifest()
            if m is None:
                raise ValueError(f"no table in {self.path}")
            if writer is not None and batch is not None and m.batches.get(writer, -1) >= batch:
                return m.version
            touched, made = change(m)
            touched = list(m.folders) if touched is None else touched
            # Buckets that another writer has changed since are computed again, the others are good.
            stale = [b for b in touched if b not in done or base is None or base.folders.get(b) != m.folders.get(b)]
            if stale:
                folder = uuid.uuid4().hex
                new = made(self._rows(m, stale)).withColumn("bucket__", self._bucket(m)).where(F.col("bucket__").isin([int(b) for b in stale]))
                new.repartition("bucket__").write.partitionBy("bucket__").parquet(f"{self.path}/data/{folder}")
                filled = {str(r[0]) for r in self.spark.read.parquet(f"{self.path}/data/{folder}").select("bucket__").distinct().collect()} if self._filled(folder) else set()
                done |= {b: folder if b in filled else "" for b in stale}
            base = m
            folders = {b: f for b, f in (m.folders | {b: done[b] for b in touched}).items() if f}
            batches = m.batches | ({writer: batch} if writer is not None and batch is not None else {})
            try:
                self._commit(Manifest(m.version + 1, m.schema, m.keys, m.buckets, folders, batches))
                return m.version + 1
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {self.retries} writers were faster")

    def _filled(self, folder: str) -> bool:
        p = self._at("data", folder)
        return any(s.getPath().getName().startswith("bucket__=") for s in p.getFileSystem(self.conf).listStatus(p))

    def _buckets_of(self, rows: DataFrame, m: Manifest) -> list[str]:
        """At most as many as the table has buckets."""
        return [str(r[0]) for r in rows.select(self._bucket(m).alias("b")).distinct().collect()]

    def _last(self, rows: DataFrame, m: Manifest, order: str | None) -> DataFrame:
        """One row per key: the last in order, of equal ones the one of the largest values."""
        columns = StructType.fromDDL(m.schema).names
        rest = [c for c in columns if c not in m.keys]
        if not rest:
            return rows.select(*m.keys).distinct()
        ranked = F.struct(*([F.col(order).alias("__order")] if order else []), *(F.col(c) for c in rest))
        return rows.groupBy(*m.keys).agg(F.max(ranked).alias("__r")).select(*m.keys, *(F.col(f"__r.{c}") for c in rest)).select(*columns)

    def upsert(self, rows: DataFrame, order: str | None = None, keep_nulls: bool = False, writer: str | None = None, batch: int | None = None) -> int:
        """SK1: rows take the place of those of equal keys; of several rows of a key the last in ``order``. X31, ST7a: with
        ``keep_nulls`` a null keeps the value that was there, and each column of several rows has its last value that isn't null.
        """

        def change(m: Manifest):
            columns = StructType.fromDDL(m.schema).names
            rest = [c for c in columns if c not in m.keys]

            def made(old: DataFrame) -> DataFrame:
                if not keep_nulls:
                    new = self._last(rows, m, order)
                    return old.join(new.select(*m.keys), m.keys, "left_anti").select(*columns).union(new.select(*columns))
                by = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in rest))
                new = rows.groupBy(*m.keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(f"__{c}") for c in rest))
                return old.join(new, m.keys, "full").select(*(F.coalesce(f"__{c}", c).alias(c) if c in rest else F.col(c) for c in columns))

            return self._buckets_of(rows, m), made

        return self._write(change, writer, batch)

    def patch(self, rows: DataFrame, order: str | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """SK2: columns of rows replace those of existing keys where they aren't null; unknown keys change nothing."""

        def change(m: Manifest):
            columns = StructType.fromDDL(m.schema).names
            named = [c for c in rows.columns if c in columns and c not in m.keys]

            def made(old: DataFrame) -> DataFrame:
                by = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in named))
                new = rows.groupBy(*m.keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(f"__{c}") for c in named))
                return old.join(new, m.keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in named else F.col(c) for c in columns))

            return self._buckets_of(rows, m), made

        return self._write(change, writer, batch)

    def delete(self, condition: Column, writer: str | None = None, batch: int | None = None) -> int:
        """SK3: rows that a predicate holds for go; unknown counts as no."""
        return self._write(lambda m: (None, lambda old: old.where(~F.coalesce(condition, F.lit(False)))), writer, batch)

    def replace(self, rows: DataFrame) -> int:
        """SK4: drop all rows and write anew."""
        return self._write(lambda m: ([str(b) for b in range(m.buckets)], lambda _: rows.select(*StructType.fromDDL(m.schema).names)), None, None)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last ``keep`` and the data that only they hold; returns the number of folders that went.

        Only when no write is going on: its data are not in a manifest yet.
        """
        known = self.versions()
        live = {f for v in known[-keep:] for f in self.manifest(v).folders.values()}
        for v in known[:-keep]:
            p = self._at("versions", f"{v:020d}.json")
            p.getFileSystem(self.conf).delete(p, False)
        data, gone = self._at("data"), 0
        fs = data.getFileSystem(self.conf)
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in live:
                gone += fs.delete(s.getPath(), True)
        return gone


def upsert_stream(stream: DataFrame, table: VersionedTable, writer: str, checkpoint: str, order: str | None = None, keep_nulls: bool = False, **trigger):
    """SK1, ST7a as a stream: each micro-batch is one commit, and a batch that is replayed after a failure changes nothing."""

    def one(rows: DataFrame, batch: int) -> None:
        table.upsert(rows, order, keep_nulls, writer, batch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


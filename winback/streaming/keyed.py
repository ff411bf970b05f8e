"""Keyed tables kept by micro-batches: hash buckets of a few segments each, named by one small manifest a version.

A batch writes its rows into the buckets they belong to and nothing else. A bucket whose newest segments have grown alike is folded inside the same
batch, so a bucket never has more than a few segments and a row is rewritten a logarithmic number of times. The manifest of a version names
the segments of all tables of the store; it appears in one rename, after everything it names is written. Readers open what one manifest names, so they see whole
versions, across tables, whatever is being written. A version that is committed is never applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
#: Segments of a bucket at most.
SEGMENTS = 4
VERSION, BUCKET = "_version", "_bucket"


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The last version of each key's row."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), VERSION).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def folds(sizes: list[int], most: int = SEGMENTS) -> int:
    """How many of the newest segments to fold into one: while the older one isn't twice as large, or there are too many."""
    n, total = 1, sizes[-1]
    while n < len(sizes) and (sizes[-n - 1] <= 2 * total or len(sizes) - n + 1 > most):
        total += sizes[-n - 1]
        n += 1
    return n


class KeyedStore:
    def __init__(self, spark: SparkSession, folder: str, key: str = "customer_id", buckets: int = BUCKETS, segments: int = SEGMENTS) -> None:
        self.spark, self.folder, self.key, self.buckets, self.segments = spark, folder.rstrip("/"), key, buckets, segments

    # ------------------------------------------------------------ files

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._path("manifest")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))

    def _sizes(self, name: str) -> dict[str, int]:
        """Bytes of each bucket of one write, from the file system; a bucket without rows has no file."""
        path, fs = self._path(name)
        out: dict[str, int] = {}
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            bucket = f.getPath().getParent().getName().removeprefix(f"{BUCKET}=")
            if bucket.isdigit():
                out[bucket] = out.get(bucket, 0) + f.getLen()
        return out

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one) names; an empty one before the first."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": -1, "tables": {}, "meta": {}}
            version = known[-1]
        path, fs = self._path(f"manifest/{version:020d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        draft, fs = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        final, _ = self._path(f"manifest/{manifest['version']:020d}.json")
        if not fs.rename(draft, final):
            raise OSError(f"version {manifest['version']} of {self.folder} could not be published")

    # ------------------------------------------------------------ reading

    def names(self, name: str, manifest: dict | None = None) -> list[str]:
        """Folders that hold the current rows of a table."""
        table = (manifest or self.manifest())["tables"].get(name, {"buckets": {}})
        return [f"{self.folder}/{path}" for b in sorted(table["buckets"], key=int) for path, _ in table["buckets"][b]]

    def read(self, name: str, version: int | None = None, keys: DataFrame | None = None, few: bool = True) -> DataFrame | None:
        """The rows of a table as one version has them (without the key's bucket); None where it has none. With keys, only theirs are read, and if they are few,
        only buckets that hold one of them are opened."""
        manifest = self.manifest(version)
        table = manifest["tables"].get(name)
        if not table:
            return None
        if keys is not None and few:
            hit = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # one row a bucket at most
            table = {**table, "buckets": {b: s for b, s in table["buckets"].items() if b in hit}}
        schema = StructType.fromJson(table["schema"])
        paths = self.names(name, {"tables": {name: table}})
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if keys is not None:
            rows = rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return newest(rows, self.key).drop(VERSION)

    def meta(self, version: int | None = None) -> dict:
        return self.manifest(version)["meta"]

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    # ------------------------------------------------------------ writing

    def begin(self, version: int) -> "Draft | None":
        """A draft of the next version; None where this one, or a later one, is there already."""
        now = self.manifest()
        return Draft(self, now, version) if version > now["version"] else None

    def expire(self, keep: int = 2) -> int:
        """Removes manifests but the last `keep`, and data that none of those names. Returns the folders removed."""
        known = self.versions()
        used = {p.split("/")[1] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for s in t["buckets"].values() for p, _ in s}
        for v in known[:-keep]:
            path, fs = self._path(f"manifest/{v:020d}.json")
            fs.delete(path, False)
        path, fs = self._path("data")
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in used] if fs.exists(path) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)


class Draft:
    """One version being written. Nothing of it is visible before commit()."""

    def __init__(self, store: KeyedStore, before: dict, version: int) -> None:
        self.store, self.version = store, version
        self.tables, self.meta = dict(before["tables"]), dict(before["meta"])

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Rows with a version column, one file a bucket; its path and the bytes of each bucket."""
        s = self.store
        path = f"data/{self.version}-{uuid.uuid4().hex[:12]}"
        rows.withColumn(BUCKET, s._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{s.folder}/{path}")
        return path, s._sizes(path)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Takes one row a key, which replaces the key's former row, and gives the rows back as written."""
        s = self.store
        rows = rows.withColumn(VERSION, F.lit(self.version).cast("long"))
        old = self.tables.get(name, {"schema": rows.schema.jsonValue(), "buckets": {}})
        path, sizes = self._write(rows)
        schema = rows.schema
        buckets = {b: [list(x) for x in segments] for b, segments in old["buckets"].items()}
        for b, n in sizes.items():
            buckets.setdefault(b, []).append([f"{path}/{BUCKET}={b}", n])
        plan = {b: k for b in sizes if (k := folds([n for _, n in buckets[b]], s.segments)) > 1}
        if plan:
            parts = [f"{s.folder}/{p}" for b, k in plan.items() for p, _ in buckets[b][-k:]]
            merged, merged_sizes = self._write(newest(s.spark.read.schema(schema).parquet(*parts), s.key).select(*schema.names))
            for b, k in plan.items():
                buckets[b][-k:] = [[f"{merged}/{BUCKET}={b}", merged_sizes[b]]]
        self.tables[name] = {"schema": schema.jsonValue(), "buckets": buckets}
        here = [f"{s.folder}/{path}/{BUCKET}={b}" for b in sizes]
        return (s.spark.read.schema(schema).parquet(*here) if here else s.spark.createDataFrame([], schema)).drop(VERSION)

    def commit(self, **meta) -> None:
        self.store._publish({"version": self.version, "tables": self.tables, "meta": {**self.meta, **meta}})

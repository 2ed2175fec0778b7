"""Tables in versions: a store whose tables change together, each commit counted once.

A table's rows lie in folders by bucket, a hash of their key. A commit writes the buckets that it touches anew,
into folders of its own, and then publishes a manifest that names every table's folders: until it is there no
reader sees any of it, and readers of older versions keep what they read. The manifest also holds the last
batch number of each source, in the same file, so a batch that is repeated, after its commit or in
the middle of it, changes nothing the second time. What one commit costs grows with the buckets it
touches; the driver holds bucket numbers and folder names, of which there are at most ``buckets`` a table.

One writer at a time; a second one that publishes the same version is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # ---- files

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self.conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, *parts: str) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.conf).delete(path, True)

    # ---- versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Version, tables and sources; those of version 0, which nothing has been committed to, are empty."""
        known = self.versions()
        if version is None:
            version = max(known, default=0)
        if version not in known:
            if version == 0:
                return {"version": 0, "tables": {}, "sources": {}}
            raise ValueError(f"no version {version} in {self.root}")
        path = self._path("versions", f"v{version:09d}.json")
        with_lines = self.jvm.org.apache.commons.io.IOUtils
        stream = path.getFileSystem(self.conf).open(path)
        try:
            return json.loads(with_lines.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, key: str, schema: str, buckets: int = BUCKETS) -> None:
        """A table with no rows; nothing happens where there is one of the name."""
        now = self.manifest()
        if name not in now["tables"]:
            now["tables"][name] = {"key": key, "schema": T.StructType.fromDDL(schema).json(), "buckets": buckets, "folders": {}}
            self._publish(now)

    def _publish(self, manifest: dict) -> int:
        manifest = manifest | {"version": manifest["version"] + 1}
        final, part = self._path("versions", f"v{manifest['version']:09d}.json"), self._path("versions", f".{uuid.uuid4().hex}")
        out = part.getFileSystem(self.conf).create(part, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        # Without the option to overwrite a rename fails where the version is there already.
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(part, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return manifest["version"]

    # ---- tables

    def bucket(self, name: str, manifest: dict | None = None) -> Column:
        table = (manifest or self.manifest())["tables"][name]
        return F.pmod(F.xxhash64(F.col(table["key"])), F.lit(table["buckets"])).cast("int")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of rows that have the table's key."""
        return sorted(r[0] for r in keys.select(self.bucket(name)).distinct().collect())  # one row a bucket at most

    def table(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        table = self.manifest(version)["tables"][name]
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        wanted = table["folders"] if buckets is None else {str(b) for b in buckets} & set(table["folders"])
        folders = [f"{self.root}/data/{table['folders'][b]}" for b in sorted(wanted, key=int)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def last(self, source: str) -> int:
        """The last batch of the source that was committed, or -1."""
        return self.manifest()["sources"].get(source, -1)

    def commit(self, source: str, number: int, changes: dict[str, tuple[Iterable[int], DataFrame]]) -> int:
        """The version after it. changes: by table the touched buckets, and all rows that these have from now on.

        A number that the source has committed already leaves everything as it is.
        """
        now = self.manifest()
        if number <= now["sources"].get(source, -1):
            return now["version"]
        for name, (buckets, rows) in changes.items():
            buckets, table = set(buckets), now["tables"][name]
            folder = f"{name}/v{now['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
            schema = T.StructType.fromJson(json.loads(table["schema"]))
            named = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn("__bucket", self.bucket(name, now))
            if buckets:
                # A bucket's rows meet in a task or two instead of every task writing a file to every bucket.
                spread = F.pmod(F.xxhash64(*(F.col(f.name) for f in schema)), F.lit(2))
                named.where(F.col("__bucket").isin(*buckets)).repartition("__bucket", spread).write.partitionBy("__bucket").parquet(f"{self.root}/data/{folder}")
            written = {int(n.partition("=")[2]) for n in self._names("data", folder) if n.startswith("__bucket=")}
            for b in buckets:
                table["folders"].pop(str(b), None)
            table["folders"] |= {str(b): f"{folder}/__bucket={b}" for b in written}
        now["sources"][source] = number
        return self._publish(now)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep``, or commits that came to nothing, hold; how many folders."""
        known = self.versions()
        held = [self.manifest(v) for v in known[-keep:]]
        used = {folder for m in held for t in m["tables"].values() for folder in t["folders"].values()}
        n = 0
        for name in self._names("data"):
            for commit in self._names("data", name):
                inside = [b for b in self._names("data", name, commit) if b.startswith("__bucket=")]
                gone = [b for b in inside if f"{name}/{commit}/{b}" not in used]
                n += len(gone)
                if len(gone) == len(inside):
                    self._delete("data", name, commit)
                else:
                    for b in gone:
                        self._delete("data", name, commit, b)
        for v in known[:-keep]:
            self._delete("versions", f"v{v:09d}.json")
        return n

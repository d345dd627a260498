"""Tables that the micro-batches of a stream keep: one folder per batch, valid once the batch is committed.

Spark runs a micro-batch again, under the same number, if it fails before the
checkpoint says that it is done.  So every batch writes its tables into folders of
its own (a second try overwrites the first), then a marker that holds the batch's
number and a little information.  A batch up to the marked one is done and is not
applied again; a reader sees only committed folders.  Everything goes through
Spark or Hadoop's file system, so the root may lie in any store.

``state`` tables hold the latest row of each key.  A batch writes the rows that it
changed; every ``compact`` batches the changes are merged into a new base, so a
reader meets a base and a bounded number of changes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Batches whose changes are read one by one before they are merged.
COMPACT = 16
_KEPT_MARKERS = 3


class BatchStore:
    """Committed tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, compact: int = COMPACT):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact

    # -- markers ------------------------------------------------------------

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_committed")
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def head(self) -> dict | None:
        """The last committed batch: its ``batch`` number and what it told ``commit``; None before the first."""
        jvm, path, fs = self._files()
        if not fs.exists(path):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().isdigit())
        if not names:
            return None
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, names[-1]))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def done(self, batch: int) -> bool:
        """Whether a batch of this number has been applied."""
        head = self.head()
        return head is not None and batch <= head["batch"]

    def commit(self, batch: int, **told) -> None:
        """Make the folders of ``batch`` valid: the marker appears under its name by one rename."""
        jvm, path, fs = self._files()
        head = self.head() or {"bases": {}}
        text = json.dumps({"bases": head["bases"], **told, "batch": batch})
        hidden = jvm.org.apache.hadoop.fs.Path(path, f"_{batch}")
        out = fs.create(hidden, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        final = jvm.org.apache.hadoop.fs.Path(path, f"{batch:020d}")
        if not fs.rename(hidden, final):
            raise OSError(f"marker of batch {batch} could not be written under {self.root}")
        old = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().isdigit())
        for name in old[:-_KEPT_MARKERS]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path, name), False)

    # -- tables ----------------------------------------------------------------

    def folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def write(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write the batch's part of a table and read it back; a try before this one is overwritten."""
        rows.write.mode("overwrite").parquet(self.folder(table, batch))
        return self.spark.read.schema(rows.schema).parquet(self.folder(table, batch))

    def _parts(self, table: str) -> dict[int, str]:
        jvm, _, fs = self._files()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not fs.exists(path):
            return {}
        names = (f.getPath().getName() for f in fs.listStatus(path))
        return {int(n[6:]): f"{self.root}/{table}/{n}" for n in names if n.startswith("batch=")}

    def read(self, table: str, schema: StructType, only: int | None = None) -> DataFrame:
        """Committed rows of a table, or those that batch ``only`` wrote."""
        head = self.head()
        parts = self._parts(table) if head else {}
        paths = [p for b, p in sorted(parts.items()) if b <= head["batch"] and (only is None or b == only)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # -- state -----------------------------------------------------------------

    def state(self, table: str, schema: StructType, keys: list[str]) -> DataFrame:
        """The latest committed row of each key."""
        head = self.head()
        if head is None:
            return self.spark.createDataFrame([], schema)
        base = head["bases"].get(table)
        paths = {b: p for b, p in self._parts(f"{table}-changes").items()
                 if b <= head["batch"] and (base is None or b > base)}
        rows = None if base is None else self.spark.read.schema(schema).parquet(self.folder(f"{table}-base", base)) \
            .withColumn("__batch", F.lit(-1).cast("long"))
        if paths:
            more = None
            for b, p in sorted(paths.items()):  # at most ``compact`` folders
                part = self.spark.read.schema(schema).parquet(p).withColumn("__batch", F.lit(b).cast("long"))
                more = part if more is None else more.unionByName(part)
            rows = more if rows is None else rows.unionByName(more)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        values = [c for c in schema.names if c not in keys]
        return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("__batch")).alias("__v"))
                .select(*keys, "__v.*").select(*schema.names))

    def change(self, table: str, changed: DataFrame, keys: list[str], batch: int) -> dict[str, int]:
        """Write the rows of the keys that ``batch`` changed; tells ``commit`` the base to read from (argument ``bases``)."""
        schema = changed.schema
        written = self.write(f"{table}-changes", changed, batch)
        bases = dict((self.head() or {"bases": {}})["bases"])
        since = [b for b in self._parts(f"{table}-changes") if b > bases.get(table, -1)]
        if len(since) >= self.compact:
            merged = self.state(table, schema, keys).join(written.select(*keys).distinct(), keys, "left_anti") \
                .unionByName(written)
            merged.write.mode("overwrite").parquet(self.folder(f"{table}-base", batch))
            bases[table] = batch
        return bases

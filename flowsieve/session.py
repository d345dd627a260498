"""Session helpers: building a session for tests/bench, shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    # Wide feature projections generate methods larger than HotSpot will JIT
    # (8000 bytes); above this size Spark splits the stage instead, which is
    # 4-7x faster here.  Recommended on clusters too.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "flowsieve", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench.  On a cluster, the job's own session is used."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowsieve`` importable in Python workers (``addPyFile``), once per application.

    Functions run by ``mapInPandas`` / pandas UDFs / ``applyInPandas*`` refer to
    this package's modules, so executors need it exactly like a ``--py-files``
    archive.  The archive is built on the driver and Spark distributes it.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(root)
    archive = os.path.join(tempfile.mkdtemp(prefix="flowsieve-pyfiles-"), "flowsieve.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is read as is.  Only
    when it is unset (local tests) a folder of our own is created and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="flowsieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def split_huge_methods(spark: SparkSession) -> None:
    """Lower ``spark.sql.codegen.hugeMethodLimit`` from Spark's default to what HotSpot compiles; a set value stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, DEFAULT_CONF[key])


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written once under the shared checkpoint folder and read back.

    A checkpoint computes its last stage twice and keeps rows uncompressed; for more than a few rows this is cheaper.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/flowsieve-scratch/{name}-{uuid.uuid4().hex[:12]}"


def local_dir(path: str) -> str | None:
    """Local filesystem path behind a ``file:`` or plain path, else None."""
    if path.startswith("file:"):
        return path[5:]
    if "://" in path:
        return None
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def makedirs_local(path: str) -> None:
    p = local_dir(path)
    if p:
        os.makedirs(p, exist_ok=True)

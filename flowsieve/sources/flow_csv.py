"""Labelled flow CSV files: validation, header trimming, typed columns, folder reads."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import KNOWN_FEATURES

ALLOWED_EXTENSIONS = (".csv", ".txt", ".tsv", ".data")
#: CSV files of a folder, whatever the case of the extension.
CSV_GLOB = "*.[cC][sS][vV]"


class FlowSourceError(ValueError):
    pass


def flow_files(paths: list[str]) -> list[str]:
    """Allowed extensions only (case-insensitive); a second file with the same base name is skipped."""
    seen, out = set(), []
    for p in paths:
        name = os.path.basename(p.rstrip("/"))
        if os.path.splitext(name)[1].lower() not in ALLOWED_EXTENSIONS:
            raise FlowSourceError(f"{name}: not a CSV file (allowed: {', '.join(ALLOWED_EXTENSIONS)})")
        if name in seen:
            continue
        seen.add(name)
        out.append(p)
    return out


def list_files(spark: SparkSession, folder: str, glob: str = CSV_GLOB) -> DataFrame:
    """``path, length`` of the files in a folder (file contents are not read); any case of the extension."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            .select("path", "length"))


def read_flow_csv(spark: SparkSession, paths: list[str], sep: str = ",", numeric: list[str] | None = None,
                  with_file: bool = False) -> DataFrame:
    """Read flow CSVs without a schema-inference pass.

    Every column arrives as text; headers are trimmed; known feature names and
    the ``numeric`` extras become doubles with ``try_cast`` (bad text -> null,
    later cleaned to 0); everything else stays text.  Columns are taken by name:
    files with the same header line are read together, the groups are put
    together by name, and a column that a file lacks is null there.  A file
    without a data row is an error.
    """
    files = flow_files(paths)
    if not files:
        raise FlowSourceError("no flow files given")
    wanted = set(KNOWN_FEATURES) | set(numeric or [])
    parts = []
    for group in by_header(spark, files):
        raw = (spark.read.option("header", True).option("sep", sep)
               .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(group))
        cols = []
        for c in raw.columns:
            name = c.strip()
            col = F.col(f"`{c}`")
            cols.append((col.try_cast("double") if name in wanted else col).alias(name))
        if with_file:
            cols.append(F.col("_metadata.file_name").alias("file_name"))
        parts.append(raw.select(*cols))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_header(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """Files grouped by their header line, found by one distributed job.

    ``files`` is metadata (one entry per file, base names differ), and so are the
    headers that come back.
    """
    heads = {os.path.basename(unquote(r["path"])): r for r in first_lines(spark, files).collect()}
    groups: dict[str, list[str]] = {}
    for path in files:
        head = heads.get(os.path.basename(unquote(path)))
        if head is None or head["lines"] < 2:
            raise FlowSourceError(f"{os.path.basename(path)}: empty, or a header without rows")
        groups.setdefault(head["header"], []).append(path)
    return list(groups.values())


def first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``path, header, lines`` of every file that has a line with text: the first such line, and how many (at most 2) were met.

    The beginning of a file lies in one split, so tasks need not meet.  A split as
    large as a partition can be is alone in its task, which then stops after the
    lines it needs (or at once, if the split is not the file's first); only small
    files, several to a task, are read through.
    """
    conf = spark.conf
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    alone = size(conf.get("spark.sql.files.maxPartitionBytes")) - size(conf.get("spark.sql.files.openCostInBytes"))
    m = "_metadata."
    lines = spark.read.text(files).select("value", F.col(m + "file_path").alias("path"),
                                          F.col(m + "file_block_start").alias("start"), F.col(m + "file_block_length").alias("length"))

    def run(batches):
        found: dict[str, list[str]] = {}
        for batch in batches:
            start, length = batch.column("start").to_numpy(), batch.column("length").to_numpy()
            texts, paths = batch.column("value"), batch.column("path").dictionary_encode()
            code = paths.indices.to_numpy()
            for c in np.unique(code[start == 0]).tolist():
                own = found.setdefault(paths.dictionary[c].as_py(), [])
                for i in np.flatnonzero((code == c) & (start == 0)).tolist():
                    if len(own) == 2:
                        break
                    text = texts[i].as_py()
                    if text.strip(" "):
                        own.append(text)
            if batch.num_rows and length[-1] >= alone and (start[-1] != 0 or any(len(x) == 2 for x in found.values())):
                break
        kept = {p: x for p, x in found.items() if x}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array([x[0] for x in kept.values()], pa.string()),
                                          pa.array([len(x) for x in kept.values()], pa.int32())], ["path", "header", "lines"])

    return lines.mapInArrow(run, "path string, header string, lines int")


def read_flow_dir(spark: SparkSession, folder: str, **kwargs) -> DataFrame:
    """All ``*.csv`` files of a folder in name order; files without rows and folders without files are errors.

    The listing (one entry per file, empty files too) is metadata and all that the driver holds.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB).load(folder).inputFiles()
    if not found:
        raise FlowSourceError(f"{folder}: no CSV files")
    return read_flow_csv(spark, sorted(unquote(p) for p in found), **kwargs)


def file_manifest(df: DataFrame) -> DataFrame:
    """Rows and bytes per source file, with the total (from the file metadata column)."""
    from pyspark.sql import Window
    per = df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("_metadata.file_size").alias("bytes"))
    return per.withColumn("total_rows", F.sum("n_rows").over(Window.partitionBy()))

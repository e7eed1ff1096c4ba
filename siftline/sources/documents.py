"""JSON, CSV and JSON-lines files as tables, trees as tables, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_siftline_documents", None)
        if found is None:
            found = spark._siftline_documents = tempfile.mkdtemp(prefix="siftline-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/siftline-{uuid.uuid4().hex}"


_staged: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: lineage is cut, and no reader computes it again. It stays
    until the driver's process ends or unstage() is called; shuffle files go as soon as it is there, not when the driver happens
    to collect its garbage."""
    path, clean = scratch(df.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(clean, None)
    df.sparkSession.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.unset(clean) if before is None else df.sparkSession.conf.set(clean, before)
    _staged.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def unstage() -> None:
    """Delete what staged() has written. Only when all results that read it have been written."""
    with contextlib.suppress(Exception):  # at the end of the process the session may have ended
        while _staged:
            spark, path = _staged.pop()
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def checkpoints(spark: SparkSession):
    """Inside, checkpoint() has a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    yield


def write_keyed_json(rows: DataFrame, path: str, key: str, value: str, files: int = 16) -> None:
    """Documents {key: value, ...}, the keys dealt over so many files."""
    entry = F.struct(F.col(key).cast("string"), F.col(value))
    each = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    each.write.partitionBy("file").text(path)


def read_keyed_json(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(key, value): a row for each entry of documents {key: value, ...}."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value_type}>")).alias("key", "value"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, each an object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, behind what is there."""
    rows.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_trees(nodes: DataFrame, path: str) -> None:
    """Trees or graphs are tables of nodes or edges: saved as Parquet."""
    nodes.write.parquet(path)


def load_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""What the operators of this subpackage share: words, durable intermediate tables, distributed prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: Rows of a key are dealt over at most this many hash buckets, so that no task needs all rows of a hot key.
PREFIX_BUCKETS = 16384


def word_array(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once. A column of a projection would be put in place of its name wherever the
    optimiser pushes a filter, inside of lambdas even, and be computed for each element there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is null. Other columns can't clash with what an operator adds."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])


def packed(docs: DataFrame) -> DataFrame:
    """All columns as the one struct `row`: whatever an operator adds beside it, no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def field(docs: DataFrame, name: str) -> Column:
    """A column of docs inside of `row`; null if docs has none of that name."""
    return F.col("row").getField(name) if name in docs.columns else F.lit(None).cast("string")


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from `row`, those in `changed` by their new values."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Only where all run in one process may the
    session leave it out; then it is a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_siftline_dir", None)
        if found is None:
            found = spark._siftline_dir = tempfile.mkdtemp(prefix="siftline-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


#: Tables are broadcast up to so many rows and elements of their arrays, tens of bytes each; beyond, they are shuffled.
BROADCAST_ROWS = 500_000

_written: dict[str, list[tuple[SparkSession, str]]] = {}
_scopes = [""]


@contextlib.contextmanager
def scope(name: str):
    """What is materialised inside can be deleted by this name."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


#: Rows of an Arrow batch at most: texts, bitmaps and lists of hashes are kilobytes each, in several copies.
BATCH_ROWS = 2000


@contextlib.contextmanager
def writing(spark: SparkSession, clean: bool = True):
    """Settings while an intermediate table is written, or rows of texts are sent to Python: small Arrow batches, and shuffle files that go as soon as the table is
    there (clean), not when the driver happens to collect its garbage."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(batch, None)
    new = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} if clean else {}
    if now is None or not 0 < int(now) <= BATCH_ROWS:
        new[batch] = str(BATCH_ROWS)
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, survives lost executors. Tables stay until
    their scope is released or the driver's process ends."""
    path = f"{shared_dir(df.sparkSession)}/siftline-{uuid.uuid4().hex}"
    with writing(df.sparkSession):
        df.write.parquet(path)
    _written.setdefault(_scopes[-1], []).append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(name: str) -> None:
    """Delete the tables of a scope. Only for callers that have written all results that read them."""
    for spark, path in _written.pop(name, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _release_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        for name in list(_written):
            release(name)


def bounded(df: DataFrame, array: str | None = None) -> DataFrame:
    """df, written; marked for broadcast if its rows and the elements of the array column are few."""
    df = materialize(df)
    size = F.count("*") if array is None else F.count("*") + F.coalesce(F.sum(F.greatest(F.size(array), F.lit(0))), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_ROWS else df


def hash_bucket(u: Column, buckets: int = PREFIX_BUCKETS) -> Column:
    """Bucket of a 64-bit hash; buckets keep the order of the hash."""
    return F.shiftright(u, 64 - (buckets.bit_length() - 1)) + F.lit(buckets // 2)


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], bucket: str, values: dict[str, str], narrow: DataFrame | None = None) -> DataFrame:
    """Exclusive running sums within each key, without putting a key's rows into one task.

    bucket: an integer column that rises with the order within a key; sums of buckets are added up first, then rows
    within their bucket. values: name of the new column -> column to sum (null counts as 0). Nulls in keys are a key.
    narrow: the same rows with fewer columns, for the sums of buckets.
    """
    sums = (df if narrow is None else narrow).groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, bucket]],
        *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    on = F.lit(True)
    for k in [*keys, bucket]:
        on = on & df[k].eqNullSafe(offsets[f"_k_{k}"])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, on)
    return joined.select(
        *df.columns, *[(F.col(f"_o_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in values.items()]
    )

"""What the operators of this subpackage share: words, tables in the shared folder, prefix sums."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder will do for a
    session in one process; on a cluster it would lose data, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="sheetwise-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give memory that a Python worker has freed back to the system: workers outlive their stage, and the allocators
    keep what a stage needed at its peak. Without effect where the C library has no such call."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Exclusive running sum of `value` per key over `order`, in two levels.

    Rows are dealt into `buckets` hash buckets of their order columns; a bucket is summed before its
    sums are accumulated, so that a key with a third of all rows is spread over all buckets and no
    window sees more than that share of it. Order is by bucket, then by `order`.
    """
    b = f"_{out}_bucket"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(int(buckets))))
    sums = df.groupBy(*keys, b).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(b).alias("_kb"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [df[k].eqNullSafe(sums[f"_k{i}"]) for i, k in enumerate(keys)] + [df[b] == sums["_kb"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return df.join(sums, cond).withColumn(out, F.col("_in") + F.col("_base")).drop(b, "_in", "_base", "_kb", *(f"_k{i}" for i in range(len(keys))))


#: Bytes that a broadcast table may have on its way to every executor.
BROADCAST_BYTES = 32 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a materialised table is counted to be within BROADCAST_BYTES: 32 bytes a row of a hashed relation and 16
    for each column, besides what strings and binaries hold."""
    wide = [F.coalesce(F.length(c).cast("long"), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    row = 32 + 16 * len(table.columns)
    most = BROADCAST_BYTES // row + 1
    n, held = table.limit(most).agg(F.count("*"), F.coalesce(F.sum(sum(wide, F.lit(0))), F.lit(0))).first()
    return n < most and n * row + held <= BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a materialised table of ids: broadcast if it is counted to be small, else left to shuffle."""
    if is_small(small):
        small = F.broadcast(small)
    return big.join(small, on, how)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished stages that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner runs beside


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, label): for each node of an edge the smallest node it is connected to.

    Each round lowers the label of a node, and that of the node it names, to the least label next to it, then
    jumps along that label, until nothing changes: labels only fall, and once none does they are equal along
    every edge. Every round is written, so a lost executor costs one round. Hot nodes only meet sums and joins
    that adaptive execution can split.
    """
    both = materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["v"] == near["a"], "left").select("v", "label", F.least("label", "m").alias("low"))
        own, root = F.struct("v", "low", F.col("label").alias("old")), F.struct(F.col("label").alias("v"), "low", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        step = step.select(F.explode(F.array(own, root)).alias("x")).select("x.*").groupBy("v").agg(F.min("low").alias("low"), F.max("old").alias("old"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "low", "left").select("v", F.least("low", "far").alias("label"), "old"), "cc-labels")
        labels = new.select("v", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels

"""Spark plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vector positions that one row of a partial count covers.
CHUNK = 1 << 14
COUNTS_SCHEMA = "chunk int, label string, index binary, value binary"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a fresh one for Spark in this process, an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; so is the need
            return


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The slices of each run of equal values in the first column, which is sorted and has no nulls."""
    part: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if part and key[lo] != last:
                yield part
                part = []
            part.append(batch.slice(lo, hi - lo))
            last = key[lo]
    if part:
        yield part


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def fixed(df: DataFrame, what: str = "rows") -> DataFrame:
    """``df`` if it is a scan of files with projections and filters at most, else ``df`` saved: rows in the same splits and order at each use."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.children().head()
    return df if node.getClass().getSimpleName() == "LogicalRelation" else saved(df, what)


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, which must be ``fixed``, with a unique id for each row, also for rows that are alike or have no key.

    The ids follow the scan's splits and order, so they are the same in every use.
    """
    name = free_name(df, "__row")
    return df.withColumn(name, F.monotonically_increasing_id()), name


def count_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A count vector as rows of COUNTS_SCHEMA, without its zeros."""
    for chunk in range(0, -(-len(counts) // CHUNK)):
        part = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            yield counts_batch([chunk], [None], [at.astype(np.uint16).tobytes()], [part[at].astype(np.int64).tobytes()])


def counts_batch(chunk: list, label: list, index: list, value: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int32()), pa.array(label, pa.string()), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
        names=["chunk", "label", "index", "value"],
    )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, label, index, value in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk < 0:
                yield counts_batch([chunk], [label], [index], [value])
            else:
                total = sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
                total[np.frombuffer(index, np.uint16)] += np.frombuffer(value, np.int64)
    for chunk, total in sums.items():
        at = np.flatnonzero(total)
        yield counts_batch([chunk], [None], [at.astype(np.uint16).tobytes()], [total[at].tobytes()])


def summed(partial: DataFrame) -> DataFrame:
    """Adds up rows of COUNTS_SCHEMA by chunk, in a stream of constant size; rows of negative chunk pass."""
    return partial.repartition(partitions(partial.sparkSession), "chunk").mapInArrow(_add_up, COUNTS_SCHEMA)


def gathered(rows: list, size: int) -> np.ndarray:
    """The count vector that collected rows of ``summed`` hold."""
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
    for r in rows:
        if r["chunk"] >= 0:
            at = r["chunk"] * CHUNK + np.frombuffer(r["index"], np.uint16).astype(np.int64)
            out[at] += np.frombuffer(r["value"], np.int64)
    return out[:size]


def sampled(rows: DataFrame, columns: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``columns``, alike on every run; the column ``__hash`` orders them.

    Rows that agree in the columns are one row here, so no number of repeats, of nulls
    or of one key makes the sample larger or leaves other rows out.
    """
    hashed = rows.select(*columns, F.xxhash64(*columns, F.lit(seed)).alias("__hash"))
    least = hashed.select("__hash").distinct().orderBy("__hash").limit(n + 1).agg(F.count(F.lit(1)).alias("n"), F.max("__hash").alias("h")).first()
    return (hashed if least["n"] <= n else hashed.where(F.col("__hash") < F.lit(least["h"]))).dropDuplicates(["__hash"])

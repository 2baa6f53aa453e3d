"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes outside space and \t \n \v \f \r, which is
#: what ``bytes.split()`` cuts at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Whether the shuffle files of a statement go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    It is the folder the cluster names in ``spark.checkpoint.dir``.  Only where
    that setting is absent and all runs in one process (local tests) a folder of
    this machine is used; a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = os.path.join(tempfile.gettempdir(), "tidelane-checkpoints")
    os.makedirs(local, exist_ok=True)
    return local


def save(df: DataFrame, name: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and return a scan of it.

    ``plain`` names columns (paths in the file) of values that hardly repeat, for
    which the writer builds no dictionary.  The lightest compression level serves
    tables that are read once or twice.

    The files outlive a lost executor; later stages never recompute what made
    them, so the shuffle files behind them go with the end of the write.
    ``release`` deletes the table early; the cluster clears what is left, as it
    does for checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelane/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        options = {f"parquet.enable.dictionary#{c}": "false" for c in plain}
        df.write.options(compression="zstd", **{"parquet.compression.codec.zstd.level": "1"}, **options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def release(*saved: DataFrame) -> None:
    """Delete the files of saved tables that nothing unevaluated reads any more."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut to about ``most`` bytes each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What this worker remembers between tasks, by operator.
_REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What this worker remembers for the operator's next tasks, until a task of another one ends."""
    return _REMEMBERED.setdefault(operator, {})


def give_back(operator: str = "") -> None:
    """Forget what other operators remember here, and return what this process has freed
    to the machine: Arrow's pool and the C library's heap keep it otherwise."""
    for other in set(_REMEMBERED) - {operator}:
        del _REMEMBERED[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def thrifty(run: Callable, operator: str = "") -> Callable:
    """A function of Arrow batches whose worker gives its memory back at the task's end,
    but for what it remembers for ``operator``.

    Spark keeps idle Python workers for a minute; what they still hold would lie
    beside the executor's heap while a later stage fills that.
    """

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back(operator)

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the edges (u, v).

    Returns the sorted nodes and, for each, the least node of its component.
    """
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node that keeps the components of (u, v): node to least node."""
    if len(u) == 0:
        return u[:0], v[:0]
    nodes, roots = least_labels(u, v)
    keep = nodes != roots
    return nodes[keep], roots[keep]


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has long columns ``a`` and ``b``.  Returns (node, root) for every
    node that is not the least of its component.  Each round is a partially
    aggregated minimum and an equi-join whose skewed keys adaptive execution can
    split; nothing is gathered in one task or on the driver but two sums that
    tell whether the edges changed.  Rounds go on until they do not; their number
    grows with the logarithm of the longest path.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = save(e, "edges")
    seen = None
    while True:
        # large star: a node's larger neighbours move to its least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, old = save(large, "large-star"), e
        release(old)
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = save(small, "small-star")
        release(large)
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_if(F.col("a") <= F.col("b")).alias("bad")).first()
        if (row["n"], row["h"]) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (row["n"], row["h"])

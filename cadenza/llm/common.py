"""Helpers shared by the training-data operators: tables, scratch space, Arrow batches.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``
(read from the session); only where that is unset and one machine runs all, as in tests, a
folder is made here.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: texts are long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Bits of a filter of ids for each id, at least; of a piece of it, as a power of two.
ID_BITS, PIECE_BITS = 32, 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so that a worker's memory doesn't depend on text lengths.

    Results are lazy, so the limits stay in the session; lower ones that it has already are left.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = str(spark.conf.get(name)).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give freed memory back to the system: workers live on and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory given back at the end of each task."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return lean_run


def lean_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``run`` for applyInArrow, with memory given back after each large group."""

    def result(out: pa.Table, *tables: pa.Table) -> pa.Table:
        if sum(t.nbytes for t in tables) > 1 << 20:
            trim()
        return out

    def one(rows):  # Spark tells grouped from cogrouped functions by hints, if there are any
        return result(run(rows), rows)

    def two(first, rows):  # a key and its rows, or two tables
        return result(run(first, rows), rows)

    return one if run.__code__.co_argcount == 1 else two


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        for spark, path in list(_written):
            name = path.rsplit("/", 1)[1]
            if f"/{name}/" in f:
                _delete(spark, path)
                _written.remove((spark, path))


class Scratch:
    """The tables that one call stores; those that its result doesn't read are dropped before it returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        out = stored(df, tag)
        self.paths[id(out)] = (_written[-1], out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            entry, _ = self.paths.pop(id(df), (None, None))
            if entry in _written:
                _delete(*entry)
                _written.remove(entry)

    def drop_but(self, *keep: DataFrame) -> None:
        """Drop all that this call has stored but ``keep``, which its lazy result reads."""
        self.drop(*[df for _, df in list(self.paths.values()) if not any(df is k for k in keep)])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


def _piece(key: tuple, rows: pa.Table) -> pa.Table:
    """A piece of the filter of ids: its bits at the rows' places."""
    bits = np.zeros(1 << PIECE_BITS, np.uint8)
    bits[rows.column("at").to_numpy() & ((1 << PIECE_BITS) - 1)] = 1
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def with_ids(rows: DataFrame, id_col: str, ids: DataFrame, n: int, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """``rows`` (id, text) but for most of those whose id isn't among the n ``ids`` (k); what ``then`` makes of their batches, if given.

    A broadcast of some bytes for each id tells them: a bit for each hash. So only texts that are asked for, and at
    most a row in ``ID_BITS`` of the others, reach a join, whatever plan it takes.
    """
    power = max(PIECE_BITS, (n * ID_BITS - 1).bit_length())
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << power) - 1))
    at = ids.select(place("k").alias("at")).withColumn("piece", F.shiftright("at", PIECE_BITS))
    bits = np.zeros(1 << power >> 3, np.uint8)
    for r in at.groupBy("piece").applyInArrow(lean_group(_piece), "piece long, bits binary").collect():
        bits[r.piece << PIECE_BITS >> 3 : (r.piece + 1) << PIECE_BITS >> 3] = np.frombuffer(r.bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            x = batch.column(2).to_numpy()
            held = bits[x >> 3] >> (x & 7).astype(np.uint8) & 1
            yield batch.select([0, 1]).filter(pa.array(held.astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # one function, one worker for each task
        yield from then(kept(batches)) if then else kept(batches)

    some = rows.select(id_col, "text").where(F.col(id_col).isNotNull())
    return some.withColumn("at", place(id_col)).mapInArrow(lean(run), schema or some.schema)


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the held-out rows. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[list[tuple[str, int]], list[int]]:
    """At most ``rows`` labelled texts of each class from folds other than 1, and both classes' sizes there.

    The sample is bounded and the same on every run: of each class, the ids with the
    smallest hash. Ids are chosen before any text moves; of a repeated id, the least text.
    Texts are whole, whatever their length.
    """
    y = labels.select(F.col("doc_id").alias("j"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    y = y.where(crc_fold("j") != 1).groupBy("j").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    zero, one = (y.where(F.col("y") == c).orderBy(F.xxhash64("j"), "j").limit(rows) for c in (0, 1))
    picked = F.broadcast(zero.unionByName(one))  # 2 * rows ids at most
    d = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    texts = d.join(picked, F.col("i") == F.col("j")).groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return sorted((r.t, r.y) for r in texts.select("t", "y").collect()), [sizes.get(c, 0) for c in (0, 1)]

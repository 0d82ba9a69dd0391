"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows handed to a Python worker at once; texts can be long, so this is small.
SLICE_CHARS = 1 << 20
#: Bytes of the rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Folders that go when the application ends.
MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as set by the cluster.

    Only a local session (tests, a laptop) may leave ``spark.checkpoint.dir``
    unset; a temporary folder takes its place there.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.pulsegrid.scratch", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.pulsegrid.scratch", root)
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: what is lost with an executor afterwards is read
    from the files, and Python work before it is not repeated.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    if (root := shared_dir(spark)) not in MARKED:
        MARKED.add(root)
        _folder(spark, root, lambda files, at: files.deleteOnExit(at))
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str, do: Callable) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged so far; frames that still read it must be done."""
    _folder(spark, shared_dir(spark), lambda files, at: files.delete(at, True))


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound the bytes of a batch on its way to a Python worker, besides its rows, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1b") == "1b":
        spark.conf.set(key, f"{limit}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Return free memory to the system: a worker lives on through stages that need none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_batches(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list] | None],
    schema: T.StructType,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply ``fn`` to slices of rows, given and returned as lists by column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sizes = next((c for c in cols.values() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), None)
            step = batch.num_rows
            if sizes is not None and batch.num_rows:
                step = max(1, int(batch.num_rows * SLICE_CHARS / max(1, sizes.nbytes)))
            for at in range(0, batch.num_rows, max(1, step)):
                part = {n: c.slice(at, step).to_pylist() for n, c in cols.items()}
                out = fn(part, state) if setup else fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list, object], list[bool]], shared: object) -> DataFrame:
    """Rows whose ``text`` a function of texts keeps; ``shared``, or what it broadcasts, is sent once, of bounded size.

    Every column passes through unchanged, so no join brings them back.
    """
    sent = shared if isinstance(shared, Broadcast) else docs.sparkSession.sparkContext.broadcast(shared)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            step = max(1, int(batch.num_rows * SLICE_CHARS / max(1, texts.nbytes)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                yield part.filter(pa.array(keep(part.column(at).to_pylist(), sent.value), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)

"""What the operators share: the shared work folder, written tables, batches of bounded size."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch to Python; texts may be long.
ARROW_ROWS = 1000
#: Bytes of text that a Python task handles at a time; a longer text is handled alone.
BLOCK_BYTES = 2 << 20


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracewell-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a session in one process,
    as in tests, gets a folder of its own; a cluster, whose machines would each write to their own disk, an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = _own_folder()
    folder = f"{top.rstrip('/')}/tracewell/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(folder)
    return folder


_made: list[str] = []
#: Tables written within the innermost scratch() of this thread.
_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


def release(spark: SparkSession) -> None:
    """Deletes all work folders that this process made: when no result that reads them is needed any more."""
    while _made:
        remove(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage, survives lost executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return _table(df, folder)


def _table(df: DataFrame, folder: str) -> DataFrame:
    if (tables := _scratch.get()) is not None:
        tables.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at its end: for steps whose result doesn't read them. Shared files stay."""
    token = _scratch.set(tables := [])
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in tables:
            remove(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of what make() gives, written; the tables that make() wrote on its way are deleted."""
    with scratch(spark):
        df, folder = make(), work_folder(spark, name)
        df.write.parquet(folder)
    return _table(df, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that is no longer read."""
    if folder in _made:
        _made.remove(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _put(spark: SparkSession, name: str, raw: bytes) -> str:
    """Writes a file of bounded size into the shared folder; gives its place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark, 'share')}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(raw))
    out.close()
    return place.toString()


def share(spark: SparkSession, name: str, raw: bytes) -> str:
    """Puts a file of bounded size into the shared folder, from which each executor fetches it.

    Gives the name under which SparkFiles finds it on every machine; workers map it, so one copy serves them all.
    """
    name = f"{name}-{hashlib.sha256(raw).hexdigest()[:16]}.bin"
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(_put(spark, name, raw))
    return name


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers where their PYTHONPATH doesn't have it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(":"))):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted((root / "tracewell").rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root))), p.read_bytes())
    name = f"tracewell-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip"
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_put(spark, name, held.getvalue()))


def fitted(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """What `fit` makes of a bounded sample, in one task of an executor: the driver gets the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([fit(pa.Table.from_batches(list(batches), schema))], pa.binary())], ["model"])

    bounded_arrow(sample.sparkSession)
    schema = to_arrow_schema(sample.schema)
    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else fit(schema.empty_table())  # without rows there is no task


def bounded_arrow(spark: SparkSession) -> None:
    """Bounds the rows, and so the bytes, that one Arrow batch brings to a Python worker, which gets this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BLOCK_BYTES))


def crc_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def hash_sample(df: DataFrame, key: Column, most: int, count: int, seed: str) -> DataFrame:
    """About `most` of `count` rows, all if there are fewer: those whose hash falls below a bound. The same rows on each run.

    Rows with equal keys are in or out together: where keys may repeat, keep one row of each."""
    if count <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < F.lit(most * (1 << 40) // count))


def stretch(text: Column, most: int, seed: str) -> Column:
    """A text of up to `most` characters whole; of a longer one so many from a place that its hash draws, the same on each run."""
    first = F.pmod(F.xxhash64(text, F.lit(seed)), F.greatest(F.length(text) - most + 1, F.lit(1)).cast("long")) + 1
    return F.substring(text, first.cast("int"), F.lit(most))


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes together, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]

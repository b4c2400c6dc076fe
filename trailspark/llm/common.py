"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage
-----------------------------------------------------------
* Only the columns an operator names are read from its input, so extra columns
  and clashing names never matter.
* A null text is an empty text; a null id stays null and is a row of its own.
* Rows are never dropped, capped or sampled to escape skew.
* Lineage is cut through ``spark.checkpoint.dir`` only. A session without it may
  run on a local master alone, where a folder of this machine stands in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.plans.session import ship

#: Python-side working set: texts are handled in slices of about this many characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, null text as empty text."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: where the session has the default batch size for Python, hand over fewer rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; set one only on a local master where none is named (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or "/tmp/trailspark-checkpoints")


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``chars`` bytes of text (one row at least): small ones are joined, large ones cut."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cum = np.cumsum(np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = int(cum[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(cum, base + chars, side="right")))
            n = int(cum[to - 1]) - base
            if held and size + n > chars:
                yield joined(held)
                held, size = [], 0
            held.append(batch.slice(at, to - at))
            size, at = size + n, to
    if held:
        yield joined(held)
        held.clear()
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings without nulls as one array, and each string's start and size in it."""
    n = len(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at[:-1] - at[0], np.diff(at)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def as_arrow(spec: str, columns: dict) -> pa.RecordBatch:
    """A record batch from ``name type, ...`` and lists or arrays."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.strip().split(" ", 1) for f in spec.split(", ")]
    arrays = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], kinds[k]) for n, k in fields]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])

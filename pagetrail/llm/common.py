"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagetrail.lineage import cut_lineage

__all__ = ["PIECES", "TOKENIZER", "TIKTOKEN", "cut_lineage", "fresh", "give_back", "in_batches", "keep", "make_room", "remainder", "table", "text_or_empty"]

#: Names of vocabulary files; their place is always a parameter.
TOKENIZER, TIKTOKEN, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def remainder(key: str, parts: int) -> Column:
    """crc32 of a key written as text, modulo ``parts``; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no given column has, whatever its case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Returns memory a task no longer needs to the system: workers live on, next to other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: How to drop what a worker keeps between tasks, by the module whose tasks use it.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Notes that a module keeps something in this worker; ``drop`` is called before a task of another module."""
    _kept[owner] = drop


def make_room(owner: str) -> None:
    """Drops what other modules keep in this worker: their work is over, and a stage of another operator needs the memory."""
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        give_back()


#: Rows and bytes of an Arrow batch: texts are long, and a batch is in memory several times on its way.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: Bytes up to which a task's memory is not worth a search.
SMALL_TASK = 1 << 16


def _bound_batches(spark: SparkSession) -> None:
    """Makes Spark's bounds on Arrow batches of this session at least as strict."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.{name}"
        given = spark.conf.get(setting, None) or ""
        if not (given.isdigit() and 0 < int(given) <= most):
            spark.conf.set(setting, str(most))


def _importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it, if they have the same folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def in_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """Arrow batches through ``fn``, partition by partition; nothing is held beyond what ``fn`` holds."""

    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        read = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal read
            for batch in batches:
                read += batch.nbytes
                yield batch

        # caches of small objects would be searched for cycles again and again; once at the end is enough
        gc.disable()
        try:
            yield from fn(counted())
        finally:
            gc.enable()
            if read > SMALL_TASK:
                give_back()

    _bound_batches(df.sparkSession)
    _importable(df.sparkSession)
    return df.mapInArrow(run, schema)

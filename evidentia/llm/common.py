"""What the operators of this subpackage share: written intermediate tables, input clean-up and small batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own_folder: dict[str, str] = {}
_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only a local session, whose executors are this machine, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "path" not in _own_folder:
        _own_folder["path"] = tempfile.mkdtemp(prefix="evidentia-")
    return _own_folder["path"]


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing written.

    Under a new name each time, so concurrent and repeated runs never see each other's files.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; to be called once the results that read them are written."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df has not got, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem, *(f"{stem}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text as the operators read them: a null text counts as empty; other columns go, save those named.

    Texts are long rows: unless the session says otherwise, Python gets them by the thousand and not by ten thousand.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, "1024")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 2 << 20, by: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into stretches of at most `rows` rows and about `size` bytes of one column; a longer row is one by itself."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(by)).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))
            end = max(at + 1, min(end, at + rows, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


def joined(batches: Iterator[pa.RecordBatch], many: int = 2) -> Iterator[pa.RecordBatch]:
    """So many batches as one, for work that repeats itself less over more rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) == many:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


#: Where workers remember tokenizers, and with them their words.
_REMEMBERED = (("tokens", "word_tokenizer"), ("token_counts", "byte_tokenizer"), ("alignment", "aligner"))


def spare(tokenizers: bool = False) -> None:
    """Give back to the machine what earlier stages, whose workers are used again, hold without need; tokenizers too, if this stage has none."""
    for module, name in _REMEMBERED if tokenizers else ():
        if f"{__package__}.{module}" in sys.modules:
            getattr(sys.modules[f"{__package__}.{module}"], name).cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

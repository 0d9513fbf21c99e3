"""Shared helpers: the shared work folder, tables that cut lineage, and Arrow batches cut to a bounded number of characters."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Characters of text that one step inside a task holds as Python words at once.
STEP_CHARS = 2_000_000


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """The default vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Unset, a temporary one serves where all is one process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyward-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, its lineage cut, safe if executors go."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes tables that stored() gave, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_crc_part(df: DataFrame, key: str, modulus: int, name: str) -> DataFrame:
    """Adds crc32(key as text) mod modulus, the fold rule of the contracts; a null key counts as empty text."""
    return df.withColumn(name, F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus)


_owner: tuple[str, Callable[[], object]] | None = None


def claim(owner: str, clear: Callable[[], object] = lambda: None) -> None:
    """Called in a task: a Python worker that Spark uses again keeps the caches of one operator at a time; clear drops the caller's."""
    global _owner
    if _owner and _owner[0] == owner:
        return
    if _owner:
        _owner[1]()
    _owner = (owner, clear)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: idle workers would keep what their largest batch took."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of text that go to a Python worker at once.
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python workers BATCH_ROWS rows at once at most, as rows of text are large (a lower setting stays)."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def steps(texts: list[str | None], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters in total, one text at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def text_steps(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), of bounded size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = [t or "" for t in column.slice(at, 1000).to_pylist()]
            for a, b in steps(texts, most):
                yield part.slice(a, b - a), texts[a:b]


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The ranges [start, start + len) of flat, one behind the other."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


def hash64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser) for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

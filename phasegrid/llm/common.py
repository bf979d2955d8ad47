"""What the operators share: reading id and text in small slices, word hashes, and stored intermediate tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.session import shared_folder

SLICE_ROWS = 128
#: Entries of a worker's word cache before it starts anew; bounds its memory.
CACHE_WORDS = 400_000


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that others are pruned and cannot clash."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(docs: DataFrame, per_slice: Callable[[list, list], dict], schema: str) -> DataFrame:
    """``per_slice(ids, texts)`` gives the columns of the rows of a slice; one narrow stage."""

    def run(batches):
        target = None
        for part in slices(batches):
            columns = per_slice(part.column(0).to_pylist(), part.column(1).to_pylist())
            target = target or arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return docs.mapInArrow(run, schema)


ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat list of ``name type``."""
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (f.strip().split(" ") for f in ddl.split(","))])


class WordHashes(dict):
    """64-bit hashes of words (bytes), one computation for each distinct word that the cache holds."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit values (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + n]
    return mixed(out)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame, shuffles: bool = True) -> None:
    """Delete stored tables that no later work reads, and let Spark delete the shuffle files behind them."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stages whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tokenizer_text(path: str) -> str:
    """A tokenizer's file, read once by the driver and sent along; vocabularies are a few MB at most."""
    with open(path, encoding="utf-8") as file:
        return file.read()

"""Shared plumbing of the training-data operators: scratch tables, text bytes, word and shingle hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.plans.tables import materialize, read_table, scratch_dir  # noqa: F401  (the operators' common plumbing)

#: The white space of every contract here: \x20 and \x09 to \x0D. ``bytes.split()`` splits on just these.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_ROWS = 256  # rows of an Arrow batch that carries texts: a long text must not meet thousands of others


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Arrow batches of few rows, so that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows of documents as one column ``row``, whatever their columns are called, beside m_doc (doc_id) and m_rk (a hash of the text)."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("m_doc"), F.xxhash64("text").alias("m_rk"))


SIEVE_BITS = 1 << 26  # 8 MB, whatever the input's size


def _sieve_place(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def marked(rows: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str], name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """rows with a truth value, name: whether the columns may be among the keys; true of more than those, but of none of those false.

    The keys are a set of bits of a fixed size, in blocks of 4 KB, which goes to every task: a bound that no input exceeds.
    Where keys fill it, all rows are marked.
    """
    block = 1 << 15
    place = _sieve_place(key_columns, bits)
    blocks = keys.select((place / block).cast("long").alias("sv_block"), (place % block).alias("sv_bit"))
    blocks = materialize(blocks.groupBy("sv_block").agg(F.bitmap_construct_agg("sv_bit").alias("sv_bits")))
    at = _sieve_place(columns, bits)
    met = rows.withColumn("sv_at", at).join(F.broadcast(blocks), (F.col("sv_at") / block).cast("long") == F.col("sv_block"), "left")
    byte = F.conv(F.hex(F.substring("sv_bits", ((F.col("sv_at") % block) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (F.col("sv_at") % 8).cast("int")) == 1, F.lit(False)).alias(name))


def sieve(rows: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str], bits: int = SIEVE_BITS) -> DataFrame:
    """rows whose columns may be among the keys (see marked()): more than those, but none of those fewer, go on to the join proper. So texts that nothing asks for are not shuffled."""
    return marked(rows, columns, keys, key_columns, "sv_met", bits).filter("sv_met").select(*rows.columns)


@functools.cache
def one_blas_thread() -> None:
    """Let NumPy's linear algebra use one thread in this process, which is a task with one core.

    Spark allows Python workers as many threads as the executor has cores; with products as small as those here, threads mostly
    wait for each other, at full load. A NumPy that brings no OpenBLAS of its own is left as it is.
    """
    try:
        with open("/proc/self/maps") as f:
            found = {x.split(maxsplit=5)[5].strip() for x in f if "openblas" in x}
    except OSError:  # no such file on this system
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(ctypes.c_int(1))


@functools.cache
def keep_freed_memory(most: int = 16 << 20) -> None:
    """Let this process keep up to ``most`` bytes of freed memory at the heap's end for its next arrays.

    By default glibc gives arrays of a megabyte back to the system as they are freed, and each new one is paid for page by page:
    where such arrays come and go in small steps, a third of the time. A C library without mallopt is left as it is.
    """
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(ctypes.c_int(-3), ctypes.c_int(most // 4))  # M_MMAP_THRESHOLD: larger arrays are mapped one by one, and go back
        library.mallopt(ctypes.c_int(-1), ctypes.c_int(most))  # M_TRIM_THRESHOLD


def lower_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.lower() leaves all other letters as they are."""
    return text.lower().split()


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbours of h; of the whole where h is shorter (nothing for nothing)."""
    n = len(h)
    if n == 0:
        return h
    size = min(size, n)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out *= _P
        out += h[k : n - size + 1 + k]
    return mix(out + np.uint64(size))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, case folded; shorter texts are one shingle, empty ones none."""
    words = lower_words(text)
    return np.unique(rolling(word_hashes(words, len(words)), size))


def digest128(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit digest."""
    d = xxhash.xxh3_128_digest(np.ascontiguousarray(values))
    a, b = np.frombuffer(d, dtype="<i8")
    return int(a), int(b)


def rows_of(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()

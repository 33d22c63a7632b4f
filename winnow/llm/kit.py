"""Helpers shared by the operators of this subpackage: scratch tables, batch plumbing, byte-level text kernels.

The kernels work on the UTF-8 bytes of an Arrow batch, cut into slices of half a MB of text (a longer document
is a slice of its own).  So a worker's memory stays bounded however many documents a partition holds: arrays over the bytes
of a slice take 4 to 8 MB, and several of them live at once.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import drop_scratch, scratch, shared_dir, ship

__all__ = ["SPACES", "Spans", "chain", "drop_scratch", "exact_sums", "hot_values", "lookup", "map_batches", "masked", "per_doc_sum", "release", "scramble", "scratch", "shared_dir", "ship", "slices", "spread", "squeeze", "table", "text_bytes", "unsqueeze", "words_of"]
SLICE_BYTES = 1 << 19
#: ASCII white space: \x20 and \x09-\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- sessions and scratch tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, between the steps of a long operator.

    Python's references reach the JVM a moment after they are given up, so this looks twice.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()


def spread(df: DataFrame, name: str, salts: int = 64) -> DataFrame:
    """df with a column of numbers under `salts` that even equal rows differ in.  df should come straight from files, whose
    rows a retry reads in the same order."""
    return df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))


def hot_values(df: DataFrame, key: str, share: int = 1000) -> list:
    """The values that hold over one in `share` rows of df: `share` of them at most."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.count()
    return [r[0] for r in counts.where((F.col("_n") * share > total) & (F.col("_n") > share) & F.col(key).isNotNull()).select(key).collect()]


def lookup(df: DataFrame, key: str, table: DataFrame, hot: list, spread_col: str, salts: int = 64) -> DataFrame:
    """df left-joined with table, which has one row per value of its column `key`.

    Rows with a null key, which find nothing, and with one of the `hot` values are dealt over `salts` tasks by
    spread_col (see spread and hot_values).
    """
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    dealt = df.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, F.col(spread_col)).otherwise(F.lit(0)))
    salted = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(salted, [key, "_salt"], "left").drop("_salt")


def masked(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(df with all columns but the needed ones under neutral names, the way back to df's columns).

    So columns that happen to be called like those an operator adds pass through it unharmed.
    """
    names = [c if c in needed else f"_kept{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)])


# ---------------------------------------------------------------- packed arrays


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; the first byte says how wide they are."""
    x = np.ascontiguousarray(values if values.dtype.kind == "u" else values.astype(np.uint64))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), dtype=np.uint8)
    return np.ascontiguousarray(x.reshape(data[0], -1).T).view(f"<u{data[0]}").ravel()


# ---------------------------------------------------------------- text of a batch as bytes


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents with about `size` bytes; a longer document stands alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        b = min(b, n, a + 65536)
        yield a, b
        a = b


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, _ODD, dtype=np.uint64)
            down = np.full(size, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _byte_codes() -> np.ndarray:
    return scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of a byte string in O(1) each, from running sums of coded bytes."""

    def __init__(self, b: np.ndarray):
        up, self.down = _power_table(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_codes()[b] * up[: len(b)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.down[start]
            return scramble(x + (end - start).astype(np.uint64) * np.uint64(_ODD))


def words_of(b: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document, with a last entry) for the runs of bytes not in gap.

    Bytes of UTF-8 beyond ASCII never equal an ASCII separator, so runs of bytes are runs of characters.
    """
    inside = np.zeros(len(b) + 1, dtype=bool)
    inside[:-1] = ~gap[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(start[:-1])
    stop = inside[:-1] & (~inside[1:] | edge[1:])
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def chain(*hashes: np.ndarray) -> np.ndarray:
    """An order-dependent hash of aligned arrays of hashes."""
    with np.errstate(over="ignore"):
        x = hashes[0]
        for h in hashes[1:]:
            x = scramble(x * np.uint64(_ODD) + h)
        return x


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; 0 for an empty run."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def exact_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] that do not depend on what stands around them: taken in whole numbers, in two parts."""
    high = np.rint(values * float(1 << 20))
    low = np.rint((values - high / float(1 << 20)) * float(1 << 52))
    return per_doc_sum(high.astype(np.int64), first) / float(1 << 20) + per_doc_sum(low.astype(np.int64), first) / float(1 << 52)

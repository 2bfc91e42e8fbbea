"""What the operators share: written tables, words as bytes and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import new_scratch

#: Odd 64-bit multipliers for mixing; fixed values of the hash, any others would do.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: A-Z lower-cased, all that is neither digit, letter nor beyond ASCII a blank.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

hash64 = xxhash.xxh3_64_intdigest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, and an executor may be lost."""
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names of its own; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def blank_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between blanks (space, tab, line feed, vertical tab, form feed, return); ``lower``: A-Z only."""
    raw = utf8(text)
    return (raw.lower() if lower else raw).split()


def alnum_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash64, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[2]
    return h ^ (h >> np.uint64(32))


def scaled(n: int, k: int) -> np.uint64:
    """``n`` times a mixing constant, modulo 2^64."""
    return np.uint64(n * int(MIX[k]) & 0xFFFFFFFFFFFFFFFF)


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values of ``a`` (at least ``n`` long)."""
    out = a[: len(a) - n + 1].copy()
    for k in range(1, n):
        out = out * MIX[0] + a[k : len(a) - n + 1 + k]
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(offsets: list[int] | np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


#: Bits of an id filter: 2 MB, whatever the number of ids.
FILTER_BITS = 1 << 24


def filter_bit(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)), F.lit(0)).cast("int")


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """Bits of the ids in ``col``, to leave out rows before a join: never one too few.

    Of fixed size, so it may be sent to every task; with very many ids it lets more rows pass.
    """
    bit = ids.select(filter_bit(F.col(col)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")
    )
    rows = words.toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def passing(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which rows, by their ``filter_bit``, may be among the ids."""
    bit = bit.astype(np.int64)
    return (bits[bit >> 6] >> (bit & 63)) & 1 == 1

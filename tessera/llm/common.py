"""What the training-data operators share: word rules, digests and Arrow helpers."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.ship import ship

#: ASCII white space, as in the class [\x20\x09-\x0D]; ``bytes.split()`` splits at exactly these.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes mapped so that ``split()`` yields the words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased.
ALNUM_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
#: Only A-Z lower-cased.
LOWER_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

BATCH_BYTES = 8 << 20
BATCH_ROWS = 256


def raw(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def white_words(text: str | None) -> list[bytes]:
    return raw(text).split()


def alnum_words(text: str | None) -> list[bytes]:
    return raw(text).translate(ALNUM_TABLE).split()


_SECOND = functools.partial(xxhash.xxh3_64_intdigest, seed=1)


def hash_words(words: list[bytes], second: bool = False) -> np.ndarray:
    """64-bit hashes of words, alike in every process; the first or second half of 128 bits."""
    return np.fromiter(map(_SECOND if second else xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_PAIR = np.uint64(0x9E3779B97F4A7C15)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two hashed sequences (order counts)."""
    return mix(mix(left + _PAIR) + right)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive entries, by doubling shorter runs."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    span, cur = 1, h
    while span * 2 <= length:
        cur, span = chain(cur[:-span], cur[span:]), span * 2
    if span < length:  # two overlapping runs cover the rest
        cur = chain(cur[:n], cur[length - span : length - span + n])
    return cur[:n]


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts don't pile up in a Python worker; and see that workers have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield column dictionaries; empty ones are left out."""
    arrow_limits(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)
    names = spark_schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(spark_schema)
        for cols in f(batches):
            if len(cols[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], type=out.field(n).type) for n in names], schema=out)

    return df.mapInArrow(run, spark_schema)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def lower_az(col):
    return F.translate(col, UPPER, LOWER)


def row_keys(first: str, second: str) -> list[Column]:
    """A 128-bit key of (doc_id, text) in two columns of the names given; rows alike in both share it."""
    return [F.xxhash64("doc_id", "text").alias(first), F.xxhash64(F.lit(1), "doc_id", "text").alias(second)]


#: A key with more than this share of all rows is hot; so there are at most HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, on: list[str], count: str, total: int) -> list[tuple]:
    """(key columns, parts) of the keys in ``counts`` with more than a thousandth of ``total`` rows.

    ``total`` is at least the sum of ``count``, so no more than HOT_SHARE keys come to the driver.
    """
    parts = F.ceil(F.col(count) * HOT_SHARE / max(total, 1)).cast("int")
    hot = counts.where(F.col(count) * HOT_SHARE > total).select(*on, parts.alias("_parts"))
    return [tuple(r) for r in hot.limit(HOT_SHARE).collect()]


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], hot: list[tuple], by: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` joined with ``keys``, so that no task gets more than about a thousandth of all rows for one key.

    The rows of a hot key (from ``hot_keys``) are dealt over its parts by the hash of the columns ``by``, and what
    ``keys`` has for it is repeated once a part; that is at most 2 * HOT_SHARE copies in all.
    """
    if not hot:
        return rows.join(keys, on, how)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    marks = F.broadcast(rows.sparkSession.createDataFrame(hot, ", ".join(f"{c} {types[c]}" for c in on) + ", _parts int"))
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(marks, on, "left").withColumn("_part", part).drop("_parts")
    each = keys.join(marks, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(each, [*on, "_part"], how).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

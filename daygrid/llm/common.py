"""Helpers that several operators share: stored tables, fresh names, words and shingles."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: the complement of ``[^\x20\x09-\x0D]``.
BLANKS = "\x20\t\n\x0b\x0c\r"

#: Odd multipliers and mixing constants of the 64-bit hashes (fixed values).
WORD_STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)

#: Distinct words a task remembers before it starts anew; bounds the memory of a worker.
WORDS_KEPT = 100_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests, a folder in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt to tasks by its keys, never sent whole through the driver.

    Spark broadcasts what takes 10 MB in files. Numbers of nodes and rows compress well, so that may be millions of rows,
    which the driver unpacks and holds as a hash table.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` separates at exactly these six code points."""
    return text.encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_B
    return x ^ (x >> np.uint64(33))


#: Places in a bitset that is sent to all tasks: 2 MB, whatever the data.
FILTER_BITS = 1 << 24


def bitset(places: DataFrame) -> np.ndarray:
    """Bits at the values of ``place`` (0 to ``FILTER_BITS`` - 1): at most ``FILTER_BITS`` / 64 rows reach the driver."""
    words = places.groupBy((F.col("place") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    # As Arrow: pandas would stay in the driver's memory.
    found = words.toArrow()
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def contains(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a bit stands at each place; false hits are possible where others share a place."""
    return (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) > 0


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets everything when it has grown to ``WORDS_KEPT``."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words: the whole sequence as one."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, width)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = acc * WORD_STEP + w[i : n - k + 1 + i]
    return np.unique(mixed(acc))

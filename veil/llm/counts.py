"""Tables of counts that models are made of, with a bound on what is sent to the workers."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pools of keys that are too many to be kept apart: a prime, by which a key's remainder is its pool.
POOLS = 65_521
#: Distinct keys that a task holds before it passes on their counts.
HOLD = 2_000_000


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def bounded(counts: DataFrame, most: int) -> DataFrame:
    """``counts`` (``key``, not negative, ``n`` and other columns) with at most ``most`` keys, and POOLS pools for all others.

    Up to ``most`` keys nothing is pooled. Beyond, those with the largest counts stay, down to a power of two,
    and the counts of all others are summed by pool: key -1 less the remainder. None is dropped.
    """
    totals = counts.groupBy("key").agg(F.sum("n").alias("n"))
    sizes = totals.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # 63 rows at most
    left, least = 0, 63
    for k, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        left += n
        if left > most:
            break
        least = k
    if left <= most:
        return counts
    kept = totals.where(F.col("n") >= F.lit(float(2**least))).select("key", F.lit(True).alias("kept"))  # ``most`` rows at most
    key = F.when(F.col("kept"), F.col("key")).otherwise(-1 - F.col("key") % POOLS)
    others = [c for c in counts.columns if c not in ("key", "n")]
    flagged = counts.join(F.broadcast(kept), "key", "left").withColumn("key", key)
    return flagged.groupBy("key", *others).agg(F.sum("n").alias("n"))


def rows_of(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Row of each asked key in a table with a row for each of ``keys`` (in order, not negative), then one for each pool."""
    if not len(keys):
        return asked % POOLS
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, len(keys) + asked % POOLS)


def table(key: np.ndarray, column: np.ndarray, n: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and counts by row (see ``rows_of``) and column, from the rows of ``bounded``."""
    keys = np.unique(key[key >= 0])
    out = np.zeros((len(keys) + POOLS, columns))
    row = np.where(key >= 0, np.searchsorted(keys, key), len(keys) - 1 - key)
    np.add.at(out, (row, column), n)
    return keys, out

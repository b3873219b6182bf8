"""A bit map of hashed ids with a fixed size, to leave most rows out of a scan before an exact join.

2**26 bits are 8 MB however many ids there are. The map has no false negatives; false positives fall to the join. With far more
ids than bits it lets everything pass, which costs time but changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

BITS = 26
_BUCKET = 15


def place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << BITS))


def id_filter(ids: DataFrame, column: str) -> Broadcast:
    """The map of the ids as a broadcast array of bits."""
    at = ids.where(F.col(column).isNotNull()).select(place(column).alias("at"))
    parts = at.groupBy(F.shiftright("at", _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << _BUCKET) - 1)).alias("bits"))
    whole = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (_BUCKET - 3)
    for bucket, bits in parts.collect():  # at most 2**11 rows of 4 KB
        whole[bucket * size : (bucket + 1) * size] = np.frombuffer(bits, np.uint8)[:size]
    return ids.sparkSession.sparkContext.broadcast(whole)


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1

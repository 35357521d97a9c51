"""Bit filters of a fixed size over 64-bit hashes: built by Spark, tested with numpy.

A filter never misses a member; a chance hit only costs work.  Its size is a constant, whatever
the data, which bounds what is gathered and broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 32768


def build(members: DataFrame, column: str, log2: int) -> np.ndarray:
    """The filter of 2**log2 bits over a column of longs: two bits for each, pre-combined per task; at most 2**log2 / 8 bytes come to the driver."""
    mask = (1 << log2) - 1
    places = members.select(
        F.explode(
            F.array(
                F.col(column).bitwiseAND(F.lit(mask)),
                F.shiftrightunsigned(F.col(column), log2).bitwiseAND(F.lit(mask)),
            )
        ).alias("place")
    )
    chunks = places.groupBy(F.expr(f"place div {_CHUNK}").alias("chunk")).agg(
        F.bitmap_construct_agg(F.expr(f"place % {_CHUNK}")).alias("bits")
    )
    out = np.zeros(1 << (log2 - 3), np.uint8)
    for row in chunks.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        out[row["chunk"] * (_CHUNK // 8) : row["chunk"] * (_CHUNK // 8) + len(part)] = part
    return out


def test(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    log2 = int(len(bits) * 8).bit_length() - 1
    mask = np.uint64((1 << log2) - 1)
    hit = np.ones(len(values), bool)
    for at in (values & mask, (values >> np.uint64(log2)) & mask):
        hit &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit

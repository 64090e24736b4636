"""A bitmap of hashed keys, small enough to broadcast, that spares most rows a join.

A row whose bit is not set has no partner; a row whose bit is set may have one and is joined. The bitmap has a fixed
size: with very many keys it spares fewer rows, and the join decides all the same.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of the map: 8 MB.
BITS = 1 << 26


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes in a long column, one aggregation row per 32,768 bits."""
    place = F.pmod(F.col(column), F.lit(BITS)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows.collect():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def rows_with_bit(df: DataFrame, column: str, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """Rows whose hash has its bit set (or, not `wanted`, has it not)."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        own = shared.value
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False) & (BITS - 1)
            hit = (own[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool) == wanted))

    return df.mapInArrow(run, df.schema)

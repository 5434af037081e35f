"""Small dimension sides: broadcast only after their size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.session import pin

#: A definition has some ten thousand parameters; a million short rows is still ~100 MB.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 1_000_000, 128 << 20


def dimension(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``df`` written once and hinted for broadcast if its rows and their bytes are few enough.

    Beyond the bounds the written copy is joined by Spark, which shuffles both sides and splits
    skewed keys at run time.
    """
    held = pin(df)
    size = F.octet_length(F.to_json(F.struct(*held.columns)))
    rows, octets = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(held) if rows <= max_rows and octets <= max_bytes else held

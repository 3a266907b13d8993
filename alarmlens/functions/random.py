"""A counter-based generator: a number in [0, 1) for each key, the same on any partitioning and in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(stream: str, *keys) -> Column:
    text = F.concat_ws("|", F.lit(stream), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(stream: str, *keys: str) -> str:
    parts = ", ".join([f"'{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE)"

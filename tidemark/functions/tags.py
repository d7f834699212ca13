"""Tags: the dictionary hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_hash(key: Column, value: Column) -> Column:
    """Java's string hash of "key=value" over UTF-16 units, as signed lower-case base 16. Different pairs may share one."""
    units = F.encode(F.concat(key, F.lit("="), value), "UTF-16BE")

    def step(h: Column, i: Column) -> Column:
        unit = F.conv(F.hex(F.substring(units, (2 * i + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
        return (h * 31 + unit).bitwiseAND(F.lit(0xFFFFFFFF))

    n = (F.octet_length(units) / 2).cast("long")
    h = F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0).cast("long"), step)
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.when(signed < 0, F.concat(F.lit("-"), F.lower(F.hex(-signed)))).otherwise(F.lower(F.hex(signed)))

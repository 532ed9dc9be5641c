"""32-bit FNV-1a as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 32-bit FNV-1a.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_MODULUS = 4294967296


def fnv1a32(text: Column) -> Column:
    """Hash of an ASCII string, as an unsigned value in a BIGINT."""
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, 1)))
    step = lambda h, c: (h.bitwiseXOR(c.cast("bigint")) * F.lit(FNV_PRIME)) % F.lit(FNV_MODULUS)
    # sequence(1, 0) would count downwards, so the empty string is answered apart
    return F.when(F.length(text) > 0, F.aggregate(chars, F.lit(FNV_OFFSET).cast("bigint"), step)).otherwise(
        F.lit(FNV_OFFSET).cast("bigint")
    )

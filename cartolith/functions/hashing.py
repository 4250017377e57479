"""Token and window hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash definitions.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295
WINDOW_BASE, WINDOW_MODULUS, WINDOW = 31, 1000000009, 10


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a of ASCII text, as bigint."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(FNV_MASK)))


def sequence_hash(values: Column) -> Column:
    """Polynomial hash of a whole array of bigints."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, x: (h * WINDOW_BASE + x) % WINDOW_MODULUS)


def window_hashes(values: Column, width: int = WINDOW) -> Column:
    """Polynomial hash of every run of `width` values; none if there are fewer."""
    n = F.size(values)
    starts = F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: sequence_hash(F.slice(values, i, width)))


#: What stands for a token of a kind in normalised code.
PLACEHOLDERS = {"identifier": "$ID", "string": "$STR", "number": "$NUM", "type": "$TYPE"}


def placeholder_hash(kind: Column) -> Column:
    """The hash of a kind's placeholder; 0 for kinds that have none."""
    out = F.lit(0).cast("long")
    for name, shown in PLACEHOLDERS.items():
        out = F.when(kind == name, fnv1a_32(F.lit(shown))).otherwise(out)
    return out

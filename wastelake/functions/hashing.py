"""Deterministic uniforms and content hashes (no random generator anywhere)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = 42
_TWO_52 = float(2**52)


def uniform(namespace: str, *keys: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from md5 of seed, namespace and keys; the same on every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def row_json(*columns: Column) -> Column:
    """A row as one text; NULL and '' stay distinct."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

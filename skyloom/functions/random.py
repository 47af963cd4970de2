"""Random columns that depend on a seed and keys alone: the same row gets the same draw, however rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, name: str, *keys: str | Column) -> Column:
    """In [0, 1), with 48 bits, from the MD5 of seed, name and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(seed: int, name: str, *keys: str | Column) -> Column:
    """Standard normal, by Box and Muller from two uniforms."""
    u, v = uniform(seed, name + "/u", *keys), uniform(seed, name + "/v", *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)

"""Portable, seeded hash fractions: same value in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """md5 of "seed-id": the order used for every seeded permutation."""
    head = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    return F.md5(F.concat_ws("-", head, *[c.cast("string") for c in cols]))


def hash_fraction(seed, *cols) -> Column:
    """Uniform in [0, 1): the first 32 bits of the md5."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("double") / float(2**32)


# Cumulative probabilities of Poisson(1) for 0..9.
POISSON1_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
)


"""Random draws that are a pure function of (seed, key).

``F.rand`` depends on how rows are laid out in partitions, so a retried task or a
repartition changes its result.  These draws come from an MD5 of the key instead: the
same entity gets the same number on every run, cluster and engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits, exactly representable in a double


def keyed_uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1) keyed by all ``parts`` (seed, purpose, entity id, ...)."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    digits = F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10)
    return digits.cast("double") / F.lit(float(16**_HEX_DIGITS))


def keyed_sign(*parts: Column | str | int) -> Column:
    """+1 or -1 with equal probability."""
    return F.when(keyed_uniform(*parts) < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))


def poisson_cdf(rate: float = 1.0, tail: float = 1e-15) -> list[float]:
    """Cumulative Poisson probabilities until the remaining tail is below ``tail``."""
    out, term, total, k = [], math.exp(-rate), 0.0, 0
    while 1.0 - total > tail and k < 60:
        total += term
        out.append(total)
        k += 1
        term *= rate / k
    return out


def keyed_poisson(*parts: Column | str | int, rate: float = 1.0) -> Column:
    """Poisson draw by inverting the distribution function at a keyed uniform."""
    cdf = F.array(*[F.lit(c) for c in poisson_cdf(rate)])
    # binding the draw to a lambda variable hashes once per row, not once per threshold
    drawn = F.transform(F.array(keyed_uniform(*parts)), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))
    return drawn[0].cast("double")

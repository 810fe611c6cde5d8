"""Column expressions shared by the operators; all stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_if_nan(c: Column | str) -> Column:
    """NaN becomes NULL so that aggregates and defaults treat it as missing."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def day_offset(ts: Column | str, origin: Column | str) -> Column:
    """Days (double) from ``origin`` to ``ts``, independent of the session time zone.

    Built from the parts of the interval: converting zone-less timestamps to epoch
    seconds would go through the session zone and pick up daylight saving jumps.
    """
    gap = col(ts) - col(origin)
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") + part("HOUR") / 24.0 + part("MINUTE") / 1440.0 + part("SECOND") / 86400.0


def years(days: Column | str) -> Column:
    return col(days) / F.lit(DAYS_PER_YEAR)


def earliest(*cols: Column | str) -> Column:
    """Row-wise minimum that skips missing values."""
    return F.least(*[col(c) for c in cols])


def bucketize(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching rule wins; rows matching none (NULL input included) take ``default``."""
    if not rules:
        raise ValueError("bucketize needs at least one rule")
    (test, label), *rest = rules
    out = F.when(test, F.lit(label))
    for test, label in rest:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def digits_at_most(text: Column | str, limit: float, low: str = "low", high: str = "high") -> Column:
    """``low`` when the first number found in ``text`` is within ``limit``, else ``high``."""
    number = F.regexp_extract(col(text), r"[0-9]+", 0).try_cast("double")
    return F.when(number <= limit, F.lit(low)).otherwise(F.lit(high))


def log_plus_one(c: Column | str) -> Column:
    """``ln(x + 1)``; missing where x <= -1."""
    c = col(c)
    return F.when(c > -1.0, F.log1p(c))


def log_unless(measure: Column | str, value: Column | str, untouched: Iterable[str]) -> Column:
    """``ln(x + 1)`` for every measure except the named ones."""
    names = list(untouched)
    if not names:
        return log_plus_one(value)
    return F.when(col(measure).isin(names), col(value)).otherwise(log_plus_one(value))


def default_to(c: Column | str, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def significance_stars(p: Column | str) -> Column:
    p = col(p)
    return F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*")).otherwise(F.lit(""))


def count_percent(n: Column, total: Column, digits: int = 1) -> Column:
    """``"12 (34.5%)"``; missing when the total is zero."""
    return F.format_string(f"%d (%.{digits}f%%)", n.cast("long"), F.try_divide(n * 100.0, total))


def center_spread(center: Column, spread: Column, digits: int = 2) -> Column:
    """``"1.23 (0.45)"``."""
    return F.format_string(f"%.{digits}f (%.{digits}f)", center, spread)


def bounds_label(lower: Column, upper: Column, digits: int = 2) -> Column:
    """``"(0.12, 0.34)"``."""
    return F.format_string(f"(%.{digits}f, %.{digits}f)", lower, upper)


def level_position(c: Column | str, levels: Sequence[str]) -> Column:
    """Zero-based position in an ordered level list; missing when not listed."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), col(c))
    return F.when(at > 0, (at - 1).cast("int"))


def relabel(c: Column | str, mapping: dict[str, str], keep_other: bool = True) -> Column:
    """Exact-value recode; unlisted values stay unless ``keep_other`` is off."""
    c = col(c)
    out = bucketize([(c == F.lit(k), v) for k, v in mapping.items()])
    return F.coalesce(out, c) if keep_other else out


def strip_first(c: Column | str, token: str) -> Column:
    """Remove the first occurrence of a literal token."""
    c = col(c)
    at = F.instr(c, token)
    cut = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(token), F.length(c)))
    return F.when(at > 0, cut).otherwise(c)


def pretty_label(
    c: Column | str,
    strip: Sequence[str] = (),
    exact: dict[str, str] | None = None,
    rules: Sequence[tuple[str, str, str]] = (),
) -> Column:
    """Readable label: drop the first dot, underscores to blanks, strip tokens, then rules.

    ``exact`` maps whole names, ``rules`` are ``(pattern, token, replacement)``: the first
    pattern that matches replaces the first ``token``.  Everything else is title-cased.
    """
    text = F.replace(strip_first(c, "."), F.lit("_"), F.lit(" "))
    for token in strip:
        text = strip_first(text, token)
    out = None
    for name, label in (exact or {}).items():
        out = (F if out is None else out).when(text == F.lit(name), F.lit(label))
    for pattern, token, replacement in rules:
        at = F.instr(text, token)
        swapped = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(replacement), F.substring(text, at + len(token), F.length(text)))
        out = (F if out is None else out).when(text.rlike(pattern), F.initcap(swapped))
    return F.initcap(text) if out is None else out.otherwise(F.initcap(text))


def decode_suffix(c: Column | str, labels: dict[str, str], default: str) -> Column:
    """Meaning of the digits inside a metric name (``importance1`` -> its label)."""
    digits = F.regexp_extract(col(c), r"[0-9]+", 0)
    return bucketize([(digits == F.lit(k), v) for k, v in labels.items()], default)


def family(c: Column | str, families: dict[str, Sequence[str]]) -> Column:
    """Group name of a value, or the value itself when it belongs to no group."""
    c = col(c)
    return F.coalesce(bucketize([(c.isin(list(v)), k) for k, v in families.items()]), c)

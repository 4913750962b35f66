"""Row-wise expressions (F1-F9): all built-in Column expressions, so they stay
inside whole-stage codegen.  Null rules are spelled out per function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "==": lambda c, v: c == v,
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compare(c, op: str, value) -> Column:
    """``c op value`` with SQL semantics (NULL in -> NULL out)."""
    return _OPS[op](col(c), F.lit(value))


def duration_days(start, end) -> Column:
    """``end - start`` in fractional days; negative allowed; NULL if either
    is NULL.  Works on TIMESTAMP and TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(86_400_000_000.0)


def in_range_or_null(c, lo, hi) -> Column:
    """keep the value when ``lo <= c <= hi`` (inclusive), else NULL."""
    return F.when(col(c).between(lo, hi), col(c))


def clip(c, lo, hi) -> Column:
    """outside -> nearest bound; NULL stays NULL (unlike greatest/least,
    which skip NULL arguments)."""
    x = col(c)
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def is_missing(c) -> Column:
    """1 when NULL else 0."""
    return col(c).isNull().cast("int")


def row_sum(cols: list[str]) -> Column:
    """sum across columns ignoring NULLs; NULL only when all are NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*[col(c) for c in cols]).isNotNull(), total)


def flag(c, op: str, value) -> Column:
    """threshold flag as 0/1 int; a NULL input gives 0 (not NULL)."""
    return F.coalesce(compare(c, op, value).cast("int"), F.lit(0))


def strip_prefix(c, prefix: str) -> Column:
    """F8: remove a literal leading prefix."""
    return F.regexp_replace(col(c), "^" + _re_escape(prefix), "")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def prefix_any(c, prefixes: list[str]) -> Column:
    """OR-chain of ``startswith``; NULL code -> false."""
    x = col(c)
    cond = reduce(lambda a, b: a | b, [x.startswith(p) for p in prefixes])
    return F.coalesce(cond, F.lit(False))


def versioned_code_predicate(version, code, rules) -> Column:
    """``OR`` over rules ``(version_value, test)`` where test is a list of
    prefixes, a regex string (``re:`` prefix) or a Column; NULL -> false."""
    parts = []
    for version_value, test in rules:
        if isinstance(test, Column):
            t = test
        elif isinstance(test, str) and test.startswith("re:"):
            t = col(code).rlike(test[3:])
        else:
            t = prefix_any(code, list(test) if not isinstance(test, str) else [test])
        parts.append((col(version) == F.lit(version_value)) & t)
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def map_values(c, mapping: dict) -> Column:
    """Value mapping; unmapped -> NULL."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[col(c)]


def round_half_up(c, digits: int = 6):
    """``floor(x * 10^d + 0.5) / 10^d``: plain IEEE arithmetic, so two
    engines that hold the same double produce the same rounded double (SQL
    ``round`` differs between engines on exact ties).  Values too large to have
    a fraction of ``digits`` places are their own rounding."""
    x = c.cast("double")
    scale = float(10 ** digits)
    whole = max(1e12, 2.0 ** 52 / scale)     # doubles from here on are spaced wider than 1 / scale
    return F.when(F.abs(x) < whole, F.floor(x * scale + 0.5) / scale).otherwise(x) + F.lit(0.0)

"""Column expressions over series (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlake.functions.parsing import let

DIFFERENCES = ("diff", "relative_diff", "ratio", "log_ratio")
MOVING = ("min", "max", "mean")
SCALERS = ("l1", "l2", "standard", "min_max_01", "min_max_11", "max_abs")


def _neighbours(c: Column, f) -> Column:
    n = F.size(c)
    return F.when(n > 1, F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), f)).otherwise(c)


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def process_series(c: Column, kind: str, past: int = 1, pad: bool = False) -> Column:
    """Sliding-window operation over ``past`` + 1 values.

    The differences are the two-value operation applied ``past`` times; min, max and mean take
    the whole window. A series shorter than the window is treated as one window. A ratio with a
    zero base or the logarithm of a number that is not positive is null.
    """
    c = c.cast("array<double>")
    if kind in DIFFERENCES:
        step = {
            "diff": lambda a, b: b - a,
            "relative_diff": lambda a, b: F.try_divide(b - a, a),
            "ratio": lambda a, b: F.try_divide(b, a),
            "log_ratio": lambda a, b: F.ln(F.try_divide(b, a)),
        }[kind]
        out = c
        for _ in range(past):
            out = _neighbours(out, step)
    elif kind in MOVING:
        reduce = {"min": F.array_min, "max": F.array_max, "mean": lambda w: _total(w) / F.size(w)}[kind]
        windows = F.greatest(F.size(c) - past, F.lit(1))
        starts = F.when(F.size(c) > 0, F.sequence(F.lit(1), windows)).otherwise(F.array().cast("array<int>"))
        out = F.transform(starts, lambda i: reduce(F.slice(c, i, F.lit(past + 1))))
    else:
        raise ValueError(f"unknown operation {kind}")
    return F.concat(F.array_repeat(F.lit(0.0), past), out) if pad else out


def scale_series(c: Column, method: str) -> Column:
    """Scale one series.

    l1 and l2 scale every value as a vector of its own, so the result is its sign. A constant
    series becomes 0 (standard) or the middle of the target range (min-max).
    """
    c = c.cast("array<double>")
    if method in ("l1", "l2"):
        return F.transform(c, lambda x: F.when(x == 0, 0.0).otherwise(x / F.abs(x)))
    if method == "standard":
        stats = F.struct(c.alias("c"), F.try_divide(_total(c), F.size(c)).alias("mean"))

        def scaled(s: Column) -> Column:
            ss = F.aggregate(s["c"], F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"]))
            sd = F.coalesce(F.sqrt(F.try_divide(ss, F.size(s["c"]) - 1)), F.lit(0.0))
            whole = F.struct(s["c"].alias("c"), s["mean"].alias("mean"), sd.alias("sd"))
            return let(whole, lambda w: F.transform(w["c"], lambda x: F.coalesce(F.try_divide(x - w["mean"], w["sd"]), F.lit(0.0))))

        return let(stats, scaled)
    ends = F.struct(c.alias("c"), F.array_min(c).alias("lo"), F.array_max(c).alias("hi"))
    if method in ("min_max_01", "min_max_11"):
        low, width = (0.0, 1.0) if method == "min_max_01" else (-1.0, 2.0)
        middle = F.lit(low + width / 2)

        def place(s: Column, x: Column) -> Column:
            return F.coalesce(F.try_divide(x - s["lo"], s["hi"] - s["lo"]) * width + low, middle)

        return let(ends, lambda s: F.transform(s["c"], lambda x: place(s, x)))
    if method == "max_abs":
        top = lambda s: F.greatest(F.abs(s["lo"]), F.abs(s["hi"]))
        return let(ends, lambda s: F.transform(s["c"], lambda x: F.coalesce(F.try_divide(x, top(s)), F.lit(0.0))))
    raise ValueError(f"unknown scaler {method}")


def extract_peaks(c: Column, peaks: int, share: float | None = None) -> Column:
    """The part of the series from the first to the (``peaks`` + 1)-th local minimum, else null.

    A local minimum ends a falling and starts a rising or level step. With ``share`` only that
    share of the lowest minima counts; of equal ones the earlier comes first.
    """
    c = c.cast("array<double>")
    inner = F.when(F.size(c) > 2, F.sequence(F.lit(1), F.size(c) - 2)).otherwise(F.array().cast("array<int>"))
    minima = F.filter(inner, lambda i: (F.get(c, i) < F.get(c, i - 1)) & (F.get(c, i + 1) >= F.get(c, i)))

    def lowest(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda i: F.struct(F.get(c, i).alias("v"), i.alias("i"))))
        return F.array_sort(F.transform(F.slice(ranked, F.lit(1), F.floor(F.size(found) * F.lit(share)).cast("int")), lambda e: e["i"]))

    def part(found: Column) -> Column:
        first, last = F.get(found, F.lit(0)), F.get(found, F.lit(peaks))
        return F.when(F.size(found) > peaks, F.slice(c, first + 1, last - first))

    return let(minima if share is None else let(minima, lowest), part)


def trim_series(c: Column, drop_left: int = 0, drop_right: int = 0, length: int | None = None) -> Column:
    """Cut a series at its ends, or to ``length`` after the left cut (null if it is too short)."""
    rest = F.slice(c, drop_left + 1, F.greatest(F.size(c) - drop_left, F.lit(0)))
    if length is not None:
        return F.when(F.size(rest) >= length, F.slice(rest, 1, length))
    return F.slice(rest, F.lit(1), F.greatest(F.size(rest) - drop_right, F.lit(0)))


def tail_mean(c: Column, n: int) -> Column:
    """Mean of the last ``n`` values, null if there are fewer."""
    return F.when(F.size(c) >= n, _total(F.slice(c, F.greatest(F.size(c) - n, F.lit(0)) + 1, F.lit(n))) / n)

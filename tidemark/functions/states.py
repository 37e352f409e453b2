"""Mergeable aggregate states: how a formula lifts raw rows, merges states and answers aggregates.

Each state is a struct column made by built-in aggregates, so partial aggregation, code generation and
column pruning work on it as on any other column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    """lift: aggregate over raw rows; merge: aggregate over states; finals: from a state to an answer."""

    name: str
    lift: Callable[..., Column]
    merge: Callable[..., Column]
    finals: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: Aggregate over a group's states that merge needs as a second argument: it is asked for first and joined.
    centre: Callable[[Column], Column] | None = None


def _at(total: Column, other: float = 0.0) -> Column:
    return F.coalesce(total, F.lit(other))


def moments_lift(x: Column) -> Column:
    """n and power sums around zero shift badly, so central sums come from the built-in stable aggregates."""
    x = x.cast("double")
    n, m2 = F.count(x).cast("double"), _at(F.var_pop(x)) * F.count(x)
    m3 = F.when(m2 > 0, _at(F.skewness(x)) * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).otherwise(0.0)
    m4 = F.when(m2 > 0, (_at(F.kurtosis(x)) + 3) * m2 * m2 / n).otherwise(0.0)
    return F.struct(F.count(x).alias("n"), _at(F.avg(x)).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), F.min(x).alias("min"), F.max(x).alias("max"))


def moments_centre(s: Column) -> Column:
    """The mean of all values behind a group's states."""
    return F.sum(s["mean"] * s["n"]) / F.nullif(F.sum(s["n"]), F.lit(0))


def moments_merge(s: Column, centre: Column) -> Column:
    """Sums of powers around the group's common mean: plain sums, so they are aggregated before the shuffle.

    With d the distance of a state's mean from the centre, (x - centre)^k summed over the state's values is a
    polynomial in d and its central sums. The centre is the mean up to rounding, so nothing cancels.
    """
    n, d = s["n"].cast("double"), s["mean"] - centre
    total, first = F.sum(n), F.sum(n * d)
    second = F.sum(s["m2"] + n * d * d)
    third = F.sum(s["m3"] + 3 * d * s["m2"] + n * d * d * d)
    fourth = F.sum(s["m4"] + 4 * d * s["m3"] + 6 * d * d * s["m2"] + n * d * d * d * d)
    off = F.coalesce(first / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return F.struct(
        F.sum(s["n"]).alias("n"),
        _at(F.max(centre) + off).alias("mean"),
        _at(F.greatest(second - total * off * off, F.lit(0.0))).alias("m2"),
        _at(third - 3 * off * second + 2 * total * off * off * off).alias("m3"),
        _at(F.greatest(fourth - 4 * off * third + 6 * off * off * second - 3 * total * off * off * off * off, F.lit(0.0))).alias("m4"),
        F.min(s["min"]).alias("min"),
        F.max(s["max"]).alias("max"),
    )


def moments_of_count(n: Column) -> Column:
    """A state that knows only how many values there are."""
    zeros = (F.lit(0.0).alias(c) for c in ("mean", "m2", "m3", "m4"))
    return F.struct(n.cast("long").alias("n"), *zeros, F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))


def moments_of_value(x: Column) -> Column:
    """The state of one value: its mean is itself, its deviation, skewness and kurtosis are zero."""
    x = x.cast("double")
    zeros = (F.lit(0.0).alias(c) for c in ("m2", "m3", "m4"))
    return F.struct(F.when(x.isNotNull(), 1).otherwise(0).cast("long").alias("n"), _at(x).alias("mean"), *zeros, x.alias("min"), x.alias("max"))


def _n(s: Column) -> Column:
    return s["n"].cast("double")


MOMENTS = Formula("moments", moments_lift, moments_merge, {
    "count": lambda s: s["n"],
    "sum": lambda s: F.when(s["n"] > 0, s["mean"] * s["n"]),
    "avg": lambda s: F.when(s["n"] > 0, s["mean"]),
    "min": lambda s: s["min"],
    "max": lambda s: s["max"],
    "variance": lambda s: F.when(s["n"] > 1, s["m2"] / (_n(s) - 1)).otherwise(0.0),
    "stddev": lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / (_n(s) - 1))).otherwise(0.0),
    "skewness": lambda s: F.when(s["m2"] > 0, F.sqrt(_n(s)) * s["m3"] / F.pow(s["m2"], F.lit(1.5))).otherwise(0.0),
    "kurtosis": lambda s: F.when(s["m2"] > 0, _n(s) * s["m4"] / (s["m2"] * s["m2"]) - 3).otherwise(0.0),
}, moments_centre)


def candle_lift(x: Column, order: Column) -> Column:
    """open and close by the least and greatest order (a struct of time and tie-break)."""
    x = x.cast("double")
    o = F.when(x.isNotNull(), order)
    return F.struct(F.min_by(x, o).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, o).alias("close"), F.sum(x).alias("volume"), F.count(x).alias("n"), F.min(o).alias("first"), F.max(o).alias("last"))


def candle_merge(s: Column) -> Column:
    return F.struct(
        F.min_by(s["open"], s["first"]).alias("open"),
        F.max(s["high"]).alias("high"),
        F.min(s["low"]).alias("low"),
        F.max_by(s["close"], s["last"]).alias("close"),
        F.sum(s["volume"]).alias("volume"),
        F.sum(s["n"]).alias("n"),
        F.min(s["first"]).alias("first"),
        F.max(s["last"]).alias("last"),
    )


def candle_array(s: Column) -> Column:
    """[open, high, low, close, volume]."""
    return F.array(*(s[c] for c in ("open", "high", "low", "close", "volume")))


def candle_json(s: Column) -> Column:
    return F.to_json(F.struct(*(s[c].alias(c) for c in ("open", "high", "low", "close", "volume")), s["n"].alias("count")))


CANDLE = Formula("candle", candle_lift, candle_merge, {
    "open": lambda s: s["open"], "high": lambda s: s["high"], "low": lambda s: s["low"], "close": lambda s: s["close"], "volume": lambda s: s["volume"],
    "first": lambda s: s["open"], "last": lambda s: s["close"], "sum": lambda s: s["volume"], "min": lambda s: s["low"], "max": lambda s: s["high"],
    "count": lambda s: s["n"], "avg": lambda s: F.when(s["n"] > 0, s["volume"] / s["n"]),
    "candle_array": candle_array, "candle_json": candle_json,
})


def sum_lift(x: Column) -> Column:
    """x: a double, or a decimal wide enough for any sum (whole numbers come as decimal(38, 0))."""
    return F.struct(F.sum(x).alias("s"), F.count(x).alias("n"))


SUM = Formula("sum", sum_lift, lambda s: F.struct(F.sum(s["s"]).alias("s"), F.sum(s["n"]).alias("n")), {
    "sum": lambda s: s["s"], "count": lambda s: s["n"], "avg": lambda s: F.when(s["n"] > 0, s["s"] / s["n"]),
})
COUNT = Formula("count", F.count, F.sum, {"count": lambda s: F.coalesce(s, F.lit(0).cast("long"))})
MIN = Formula("min", F.min, F.min, {"min": lambda s: s})
MAX = Formula("max", F.max, F.max, {"max": lambda s: s})
#: The latest end is kept as a time, so a coarser bucket needs no new offsets; span_offset gives the offset form.
SPAN_END = Formula("span_end", lambda x: F.max(F.unix_micros(x.cast("timestamp"))), F.max, {"max": F.timestamp_micros, "span_end": F.timestamp_micros})


def sketch_quantile(s: Column, q: float) -> Column:
    """Approximate quantile of a sketch; q is brought into [0, 1]."""
    return F.kll_sketch_get_quantile_double(s, F.lit(min(1.0, max(0.0, float(q)))))


#: Approximate quantiles that merge; exact ones always come from raw rows.
SKETCH = Formula("quantile_sketch", lambda x: F.kll_sketch_agg_double(x.cast("double")), F.kll_merge_agg_double, {
    "approx_median": lambda s: sketch_quantile(s, 0.5), "approx_p95": lambda s: sketch_quantile(s, 0.95),
})

FORMULAS: dict[str, Formula] = {f.name: f for f in (MOMENTS, CANDLE, SUM, COUNT, MIN, MAX, SPAN_END, SKETCH)}
ALIASES = {"stats": "moments", "ohlcv": "candle", "sketch": "quantile_sketch", "tdigest": "quantile_sketch", "quantile": "quantile_sketch", "range_max_end": "span_end", "range_merge": "span_end"}
NUMERIC = {"moments", "candle", "sum", "quantile_sketch", "product"}


def register(formula: Formula) -> None:
    """Makes a formula of one's own usable in pipelines."""
    FORMULAS[formula.name] = formula


def span_offset(end: Column, bucket: Column) -> Column:
    """Seconds from a bucket's start (epoch seconds) to the latest end in it."""
    return (F.floor(F.unix_micros(end) / 1_000_000) - bucket).cast("int")

"""Queries over pipelines: which tiers and raw rests answer a range, and the answer itself."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import refines, trunc
from tidemark.functions.states import FORMULAS, sketch_quantile
from tidemark.operators.intervals import unify_intervals
from tidemark.plans.slices import RAW, Range, Segment, slice_range, unify

if TYPE_CHECKING:
    from tidemark.operators.engine import Pipeline, Source

#: Dirty ranges that a plan works with; of more, coarser ones are made, which only sends more of the range to raw rows.
_RANGES = 10_000


@dataclass(frozen=True)
class Linear:
    """times * column + plus, as the input of sum, avg, min, max or count."""

    column: str
    times: float = 1
    plus: float = 0

    def of_rows(self) -> Column:
        return F.col(self.column) * self.times + self.plus


def _met(scopes: dict | None) -> list[Column]:
    """Conditions on scope columns: a value, a list of values, or null."""
    return [F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c).isNull() if v is None else F.col(c) == v for c, v in (scopes or {}).items()]


class Answers:
    """What an Engine answers."""

    def plan(self, name: str, start: int | None = None, end: int | None = None, scopes: dict | None = None, grain: str | None = None, zone: str = "UTC", aggs: list[tuple] = (), ranges: list[Range] | None = None) -> tuple[list[Segment], list[str]]:
        """(segments, notes): where each part of the ranges comes from, and why tiers were left out."""
        p = self.pipeline(name)
        return self._plan(p, self._ranges(p, start, end, ranges), scopes, grain, zone, aggs)

    @staticmethod
    def _ranges(p: Pipeline, start: int | None, end: int | None, ranges: list[Range] | None) -> list[Range]:
        """The asked ranges as disjoint ones; an open side ends where the rows do."""
        if ranges is not None:
            return unify(list(ranges))
        low, high = p.span or (0, 0)
        return unify([(low if start is None else start, high if end is None else end)])

    def _plan(self, p: Pipeline, ranges: list[Range], scopes: dict | None, grain: str | None, zone: str, aggs: list[tuple]) -> tuple[list[Segment], list[str]]:
        notes, rows, raw = [], p.tier_rows, [Segment(RAW, a, b) for a, b in ranges]
        if not ranges:
            return [], ["no rows"]
        for a in aggs:
            if a[1] != "*" and self._answer(p, a[0], a[1]) is None:
                return raw, [f"no tier column answers {a[0]}({a[1]})"]
        usable = []
        for f in sorted(p.frames, reverse=True):
            if f.name not in rows:
                notes.append(f"{f.name}: not built")
            elif not refines(f, grain, zone, ranges[0][0], ranges[-1][1]):
                notes.append(f"{f.name}: doesn't refine {grain} in {zone}")
            elif rows[f.name] > self.config.worth * p.rows:
                notes.append(f"{f.name}: {rows[f.name]} of {p.rows} rows, not worth it")
            else:
                usable.append(f)
        dirty = self._dirty(p, ranges, scopes) if usable and p.state["log"] else []
        segments = [s for r in ranges for s in slice_range(r, usable, dirty)]
        if len(segments) > self.config.max_segments:
            return raw, [*notes, f"{len(segments)} segments are too many"]
        return segments, notes

    def _dirty(self, p: Pipeline, ranges: list[Range], scopes: dict | None) -> list[Range]:
        """Dirty ranges of the asked scopes; times come to the driver, whatever the number of scopes."""
        inside = reduce(operator.or_, [(F.col("start") < b) & (F.col("end") > a) for a, b in ranges])
        log = self._log(p, p.state["log"]).where(reduce(operator.and_, _met(scopes), inside))
        starts = log.select("start", "end").distinct()
        widest = 1
        while starts.limit(_RANGES + 1).count() > _RANGES:
            widest *= 32
            size = p.frames[0].order * widest
            starts = starts.select((F.floor(F.col("start") / size) * size).alias("start"), (F.ceil(F.col("end") / size) * size).alias("end")).distinct()
        return [(r["start"], r["end"]) for r in unify_intervals(starts, []).collect()]

    @staticmethod
    def _answer(p: Pipeline, agg: str, column: str | Linear) -> tuple[Source, str] | None:
        """The tier column that gives exactly what raw rows do, if there is one."""
        if isinstance(column, Linear):
            inner = Answers._answer(p, agg, column.column) if agg in ("sum", "avg", "min", "max", "count") else None
            return inner if inner and (agg != "sum" or "count" in FORMULAS[inner[0].formula].finals) else None
        found = []
        for s in p.sources:
            if s.column.replace(" ", "") != column.replace(" ", "") or agg not in FORMULAS[s.formula].finals:
                continue
            exact = s.formula in ("sum", "count", "min", "max", "span_end")
            if not exact and s.kind not in ("double", "float") and agg in ("sum", "avg", "min", "max", "volume", "open", "close", "first", "last", "high", "low"):
                continue  # these states hold doubles
            found.append((not exact, s))
        return (min(found, key=lambda x: x[0])[1], agg) if found else None

    @staticmethod
    def _final(source: Source, agg: str, state: Column, column: str | Linear) -> Column:
        """The answer from a state, of the type that raw rows give."""
        of = FORMULAS[source.formula].finals
        if isinstance(column, Linear):
            value = Answers._final(source, agg if agg in ("sum", "avg", "count") or column.times >= 0 else {"min": "max", "max": "min"}[agg], state, column.column)
            return value if agg == "count" else value * column.times + column.plus * (F.nullif(of["count"](state), F.lit(0)) if agg == "sum" else 1)
        value = of[agg](state)
        if source.formula == "sum" and agg in ("sum", "avg") and source.kind not in ("double", "float"):
            if source.kind.startswith("decimal"):
                from tidemark.operators.engine import _scale

                digits, scale = _scale(source.kind)
                return value.cast(f"decimal({min(38, digits + 10)},{scale})" if agg == "sum" else f"decimal({min(38, digits + 4)},{min(38, scale + 4)})")
            return value.cast("long") if agg == "sum" else F.when(state["n"] > 0, state["s"].cast("double") / state["n"])
        return value

    def query(self, name: str, start: int | None = None, end: int | None = None, aggs: list[tuple] = (), scopes: dict | None = None, by: list[str] | None = None, grain: str | None = None, zone: str = "UTC", where: Column | None = None, ranges: list[Range] | None = None) -> DataFrame:
        """Aggregates over [start, end), or over several ranges: aggs are (aggregate, column, alias), or ("count", "*", alias).

        A column may be a product "a * b" or a Linear. Without start or end the range ends where the rows do. scopes: values
        or lists that scope columns must have. by: scope columns to group by; others, or a filter `where` on other columns, make
        it a scan of raw rows. grain: also group by date_trunc(grain) in zone, as epoch seconds in column `bucket`.
        The answer and its types are what raw rows give, however it is sliced.
        """
        p, by = self.pipeline(name), by or []
        asked = self._ranges(p, start, end, ranges)
        strict = where is not None or not set(by) <= set(p.scopes) or not set(scopes or {}) <= set(p.scopes)
        segments = [Segment(RAW, a, b) for a, b in asked] if strict else self._plan(p, asked, scopes, grain, zone, aggs)[0]
        answers = [None if a[1] == "*" else self._answer(p, a[0], a[1]) for a in aggs]
        if any(x is None and a[1] != "*" for x, a in zip(answers, aggs, strict=True)):
            return self._from_raw(p, asked, aggs, answers, scopes, by, grain, zone, where)
        extra = _met(scopes) + ([where] if where is not None else [])
        parts = []
        for source in dict.fromkeys(s.source for s in segments) or [RAW]:
            mine = [(s.start, s.end) for s in segments if s.source == source]
            if source == RAW:
                df, t = self._raw(p, mine), F.col("__t")
            else:
                df, t = self._part_of_tier(p, source, mine), F.col("t")
            inside = reduce(operator.or_, [(t >= a) & (t < b) for a, b in mine], F.lit(False))
            df = df.where(reduce(operator.and_, extra, inside))
            keys = [*([trunc(grain, t, zone).alias("bucket")] if grain else []), *(F.col(c) for c in by)]
            parts.append(self._lift(p, df, keys) if source == RAW else df.select(*keys, *(s.alias for s in p.sources), "__rows"))
        names = [*(["bucket"] if grain else []), *by]
        one = len(parts) == 1 and segments and segments[0].source == RAW
        merged = parts[0] if one or not segments else self._merge(p, reduce(DataFrame.unionByName, parts), [F.col(c) for c in names])
        out = [F.coalesce("__rows", F.lit(0).cast("long")).alias(a[2]) if a[1] == "*" else self._final(x[0], x[1], F.col(x[0].alias), a[1]).alias(a[2]) for a, x in zip(aggs, answers, strict=True)]
        return merged.select(*names, *out)

    def _part_of_tier(self, p: Pipeline, frame: str, ranges: list[Range]) -> DataFrame:
        size = self._span(p, next(f for f in p.frames if f.name == frame))
        parts = p.state["tiers"][frame]
        only = [int(n) for n in parts if any(int(n) * size < b and (int(n) + 1) * size > a for a, b in ranges)]
        return self._tier(p, frame, parts, only)

    def _from_raw(self, p: Pipeline, ranges: list[Range], aggs: list[tuple], answers: list, scopes: dict | None, by: list[str], grain: str | None, zone: str, where: Column | None) -> DataFrame:
        """From raw rows alone; what a formula answers goes through that formula, so it doesn't depend on the other aggregates."""
        inside = reduce(operator.or_, [(F.col("__t") >= a) & (F.col("__t") < b) for a, b in ranges], F.lit(False))
        rows = self._raw(p, ranges).where(reduce(operator.and_, _met(scopes) + ([where] if where is not None else []), inside))
        order = F.struct(F.col("__us"), F.col(p.tie) if p.tie else F.lit(0))
        made = []
        for (agg, column, alias), answer in zip(aggs, answers, strict=True):
            if column == "*":
                made.append(F.count("*").alias(alias))
            elif answer:
                s = answer[0]
                state = FORMULAS[s.formula].lift(s.value(), order) if s.formula == "candle" else FORMULAS[s.formula].lift(s.value())
                made.append(self._final(s, agg, state, column).alias(alias))
            else:
                made.append(self._of_rows(agg, column, order).alias(alias))
        keys = [*([trunc(grain, F.col("__t"), zone).alias("bucket")] if grain else []), *by]
        return rows.groupBy(*keys).agg(*made)

    @staticmethod
    def _of_rows(agg: str, column: str | Linear, order: Column) -> Column:
        if isinstance(column, Linear):
            x = column.of_rows()
        elif "*" in column:
            x = reduce(operator.mul, (F.col(c.strip()).cast("double") for c in column.split("*")))
        else:
            x = F.col(column)
        quantile = lambda kind, q: F.expr(f"{kind}({q}) WITHIN GROUP (ORDER BY `{column}`)")
        special = {
            "first": lambda: F.min_by(x, order),
            "open": lambda: F.min_by(x, order),
            "last": lambda: F.max_by(x, order),
            "close": lambda: F.max_by(x, order),
            "count_distinct": lambda: F.count_distinct(x),
            "variance": lambda: F.coalesce(F.var_samp(x), F.lit(0.0)),
            "stddev": lambda: F.coalesce(F.stddev_samp(x), F.lit(0.0)),
            "median": lambda: quantile("percentile_disc", 0.5),
            "p95": lambda: quantile("percentile_disc", 0.95),
            "median_cont": lambda: quantile("percentile_cont", 0.5),
            "p95_cont": lambda: quantile("percentile_cont", 0.95),
        }
        return special[agg]() if agg in special else getattr(F, agg)(x)

    def quantiles(self, name: str, column: str, qs: dict[str, float], start: int | None = None, end: int | None = None, scopes: dict | None = None, by: list[str] | None = None) -> DataFrame:
        """Approximate quantiles, any number of them, from the column's sketches; 0 and 1 are what the sketch has least and greatest."""
        p = self.pipeline(name)
        s = next(s for s in p.sources if s.formula == "quantile_sketch" and s.column == column)
        (a, b), = self._ranges(p, start, end, None)
        segments = self._plan(p, [(a, b)], scopes, None, "UTC", [("approx_median", column, "x")])[0]
        parts = []
        for source in dict.fromkeys(x.source for x in segments):
            mine = [(x.start, x.end) for x in segments if x.source == source]
            df, t = (self._raw(p, mine), F.col("__t")) if source == RAW else (self._part_of_tier(p, source, mine), F.col("t"))
            df = df.where(reduce(operator.and_, _met(scopes), reduce(operator.or_, [(t >= x) & (t < y) for x, y in mine])))
            keys = [F.col(c) for c in by or []]
            parts.append(self._lift(p, df, keys).select(*keys, s.alias) if source == RAW else df.select(*keys, s.alias))
        merged = reduce(DataFrame.unionByName, parts).groupBy(*(by or [])).agg(FORMULAS[s.formula].merge(F.col(s.alias)).alias("s"))
        return merged.select(*(by or []), *(sketch_quantile(F.col("s"), q).alias(n) for n, q in qs.items()))

    def join(self, left: tuple[str, list[tuple]], right: tuple[str, list[tuple]], start: int | None = None, end: int | None = None, scopes: dict | None = None, by: list[str] | None = None, grain: str | None = None, zone: str = "UTC") -> DataFrame:
        """Aggregates of two pipelines joined on their groups. Range and scopes hold for both sides, so both are sliced by them."""
        sides = []
        for name, aggs in (left, right):
            p = self.pipeline(name)
            known = {c: v for c, v in (scopes or {}).items() if c in p.kinds}
            sides.append(self.query(name, start, end, aggs, known, by, grain, zone))
        return sides[0].join(sides[1], [*(["bucket"] if grain else []), *(by or [])])

    def create_view(self, view: str, name: str, *args, **how) -> None:  # noqa: ANN002,ANN003
        """Registers an answer as a temporary view, so SQL around it, subqueries and joins included, works on it."""
        self.query(name, *args, **how).createOrReplaceTempView(view)

    def rows(self, name: str, start: int, end: int, frame: str | None = None, limit: int = 5000) -> DataFrame:
        """Rows of the base table or a tier in [start, end), by time and first scope; at most `limit`, and 5000."""
        p = self.pipeline(name)
        df, t = (self._raw(p, [(start, end)]), "__t") if frame is None else (self._part_of_tier(p, frame, [(start, end)]), "t")
        inner = [c for c in df.columns if c.startswith("__")]
        return df.where((F.col(t) >= start) & (F.col(t) < end)).orderBy(t, *p.scopes[:1]).limit(min(limit, 5000)).drop(*inner)

    def explain_slices(self, name: str, start: int | None = None, end: int | None = None, **how) -> str:  # noqa: ANN003
        p = self.pipeline(name)
        segments, notes = self.plan(name, start, end, **how)
        counts: dict[str, int] = {}
        for s in segments:
            counts[s.source] = counts.get(s.source, 0) + 1
        asked = ", ".join(f"[{a}, {b})" for a, b in self._ranges(p, start, end, how.get("ranges")))
        return "\n".join([f"{name} {asked}: " + ", ".join(f"{n}x {s}" for s, n in counts.items()), *(f"  {s.source} [{s.start}, {s.end})" for s in segments), *(f"  {n}" for n in notes)])

    def validate(self, name: str, frame: str, start: int, end: int) -> DataFrame:
        """(t, scopes, column, tier, raw): buckets whose tier and raw answers differ by more than 1e-6, or that one side lacks."""
        p = self.pipeline(name)
        f = next(x for x in p.frames if x.name == frame)
        keys = ["t", *p.scopes]
        finals: dict[str, tuple[Source, str]] = {}
        for s in p.sources:
            for n in FORMULAS[s.formula].finals:
                if n in ("sum", "count", "avg", "variance"):
                    label = f"{n}({s.column})"
                    finals[label if label not in finals else f"{n}({s.alias})"] = (s, n)

        def flat(df: DataFrame, side: str) -> DataFrame:
            values = [x for label, (s, n) in finals.items() for x in (F.lit(label), FORMULAS[s.formula].finals[n](F.col(s.alias)).cast("double"))]
            return df.select(*keys, F.explode(F.create_map(*values)).alias("column", side))

        tier = flat(self._part_of_tier(p, frame, [(start, end)]).where((F.col("t") >= start) & (F.col("t") < end)), "tier")
        rows = self._raw(p, [(start, end)]).where((F.col("__t") >= start) & (F.col("__t") < end))
        raw = flat(self._lift(p, rows, [f.bucket(F.col("__t")).alias("t"), *(F.col(c) for c in p.scopes)]), "raw")
        on = reduce(operator.and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "column"]])
        both = tier.alias("a").join(raw.alias("b"), on, "full")
        apart = F.coalesce(F.abs(F.col("tier") - F.col("raw")) > 1e-6, ~F.col("tier").eqNullSafe(F.col("raw")))
        return both.where(apart).select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in [*keys, "column"]), "tier", "raw")

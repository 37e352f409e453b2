"""Pipelines of rollup tiers over a base table: definition, changes and refresh.

Below a pipeline's path:
  manifest/                               versions of the manifest
  base/__commit=<id>/__part=<n>           rows as they came, sorted by time; a part is some whole days
  tier-<frame>/__commit=<id>/__part=<n>   states by bucket; the manifest names one commit for each part
  log/<id>                                buckets of the smallest frame that a change touched

Every change is one new manifest version, so a failure between its steps leaves the version before it. Rows are never
updated in place. A refresh reads and writes only the parts that hold dirty buckets.
"""

from __future__ import annotations

import json
import math
import operator
import re
import time
import uuid
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import Frame, epoch_seconds, parse_frames, refines
from tidemark.functions.states import ALIASES, FORMULAS, NUMERIC, span_offset
from tidemark.operators.answers import Answers
from tidemark.operators.intervals import unify_intervals
from tidemark.operators.manifest import Conflict, Files, Manifest
from tidemark.sources.tables import as_utc

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_NUMBERS = (*_WHOLE, "float", "double")
DAY = 86400
#: Base rows that a folder should hold, and the least and most folders that are planned for.
_FOLDER_ROWS, _LEAST, _MOST = 4_000_000, 32, 4096
#: Part of rows without a time.
_TIMELESS = -(1 << 31)


@dataclass(frozen=True)
class Source:
    """A column of every tier: a formula over a base column, or over the product of two."""

    column: str
    formula: str
    alias: str
    kind: str = "double"

    def value(self) -> Column:
        """The input of the formula. Sums of whole numbers and decimals are exact."""
        if "*" in self.column:
            return reduce(operator.mul, (F.col(c.strip()).cast("double") for c in self.column.split("*")))
        if self.formula != "sum":
            return F.col(self.column)
        if self.kind in _WHOLE:
            return F.col(self.column).cast("decimal(38,0)")
        if self.kind.startswith("decimal"):
            return F.col(self.column).cast(f"decimal(38,{_scale(self.kind)[1]})")
        return F.col(self.column).cast("double")


def _scale(kind: str) -> tuple[int, int]:
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    return int(m[1]), int(m[2])


@dataclass(frozen=True)
class EngineConfig:
    max_segments: int = 100
    zone: str = "UTC"
    #: A tier is used only if it has at most this part of the raw rows.
    worth: float = 0.9
    #: Files that no version names are deleted after so many seconds, when no reader can still want them.
    grace: int = 86400


@dataclass
class Pipeline:
    name: str
    path: str
    anchor: str
    scopes: list[str]
    frames: list[Frame]
    sources: list[Source]
    schema: T.StructType
    tie: str | None
    #: Path of a table that stays where it is; inserts go beside it.
    table: str | None
    #: Seconds of base rows in one folder.
    part: int
    state: dict = field(repr=False)

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.schema}

    @property
    def rows(self) -> int:
        return self.state["table_rows"] + sum(n for parts in self.state["base"].values() for n in parts.values())

    @property
    def tier_rows(self) -> dict[str, int]:
        return {f: sum(n for _, n in parts.values()) for f, parts in self.state["tiers"].items()}

    @property
    def span(self) -> tuple[int, int] | None:
        """[start, end) that holds every row with a time, from the manifest."""
        numbers = [int(p) for parts in self.state["base"].values() for p in parts if int(p) != _TIMELESS]
        ends = [(min(numbers) * self.part, (max(numbers) + 1) * self.part)] if numbers else []
        if self.state["table_span"]:
            ends.append(tuple(self.state["table_span"]))
        return (min(a for a, _ in ends), max(b for _, b in ends)) if ends else None


def directives(text: str) -> list[tuple[str, str, str]]:
    """(column, formula, alias) of "formula as alias, product(a, b)" after a column name; commas in brackets don't cut.

    What can't be read is left out with a warning.
    """
    column, _, rest = text.strip().partition(" ")
    out = []
    for part in re.split(r",(?![^()]*\))", rest):
        m = re.fullmatch(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*(?:[aA][sS]\s+(\w+))?\s*", part)
        if not m:
            warnings.warn(f"directive {part.strip()!r} of {column} left out", stacklevel=2)
        elif m[1] == "product" and m[2]:
            a, b = (x.strip() for x in m[2].split(","))
            out.append((f"{a} * {b}", "sum", m[3] or f"{a}_{b}_product"))
        else:
            out.append((column, ALIASES.get(m[1], m[1]), m[3] or f"{column}_{ALIASES.get(m[1], m[1])}"))
    return out


class Engine(Answers):
    """Keeps pipelines below a folder that all executors share. Another session with the same folder sees the same pipelines."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or EngineConfig()
        self.files = Files(spark, self.path)

    # definition

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.path) if self.files.names(f"{self.path}/{n}/manifest")]

    def pipeline(self, name: str) -> Pipeline:
        """The pipeline as its latest manifest has it."""
        state = Manifest(self.spark, f"{self.path}/{name}").latest()
        if state is None:
            raise KeyError(name)
        d = state["definition"]
        frames, sources = parse_frames(d["frames"], d["zone"]), [Source(*s) for s in d["sources"]]
        return Pipeline(name, f"{self.path}/{name}", d["anchor"], d["scopes"], frames, sources, T.StructType.fromJson(d["schema"]), d["tie"], d["table"], d["part"], state)

    def accelerate(self, name: str, base: DataFrame | str, frames: str | None = None, tenant: list[str] | None = None, columns: list[str] | None = None, time_column: str | None = None, tie: str | None = None, initial_load: bool = True) -> Pipeline:
        """Defines a pipeline and builds its tiers. Defining a name again gives the pipeline there is.

        base: rows to copy, or the path of a Parquet table that stays where it is. columns: "column formula [as alias], ...";
        columns that base lacks are left out with a warning. Without initial_load every bucket of base is dirty.
        """
        if name in self.names():
            return self.pipeline(name)
        rows = as_utc(self.spark.read.parquet(base)) if isinstance(base, str) else base
        kinds = dict(rows.dtypes)
        anchor = time_column or next((c for c, k in rows.dtypes if k in ("timestamp", "timestamp_ntz", "date")), "t" if kinds.get("t") == "bigint" else None)
        if anchor is None or anchor not in kinds:
            raise ValueError(f"{name}: no time column")
        scopes = list(tenant or [])
        sources = self._sources(name, kinds, anchor, scopes, columns)
        definition = {"anchor": anchor, "scopes": scopes, "frames": frames or "1m,1d,1M", "zone": self.config.zone, "sources": [[s.column, s.formula, s.alias, s.kind] for s in sources], "schema": json.loads(rows.schema.json()), "tie": tie, "table": base if isinstance(base, str) else None}
        t = epoch_seconds(F.col(anchor), kinds[anchor])
        n, low, high = rows.agg(F.count("*"), F.min(t), F.max(t)).first()
        days = 1 if low is None else (high - low) / DAY / min(_MOST, max(_LEAST, n / _FOLDER_ROWS))
        definition["part"] = DAY << max(0, math.ceil(math.log2(max(1.0, days))))
        table_rows, table_span = (n, None if low is None else [low, high + 1]) if isinstance(base, str) else (0, None)
        start = {"version": 0, "definition": definition, "base": {}, "hidden": {}, "table_rows": table_rows, "table_span": table_span, "tiers": {}, "log": [], "batches": {}}
        Manifest(self.spark, f"{self.path}/{name}").change(lambda _: start)
        p = self.pipeline(name)
        if not isinstance(base, str):
            self._add(p, rows, log=not initial_load)
        elif not initial_load:
            self._log_change(p, rows)
        if initial_load:
            self.refresh(name)
        else:  # built, with nothing in it and everything dirty
            self._manifest(p).change(lambda now: now | {"tiers": {f.name: {} for f in p.frames}})
        return self.pipeline(name)

    @staticmethod
    def _sources(name: str, kinds: dict[str, str], anchor: str, scopes: list[str], columns: list[str] | None) -> list[Source]:
        number = lambda k: k in _NUMBERS or k.startswith("decimal")
        if not columns:
            return [Source(c, "sum", f"{c}_sum", k) for c, k in kinds.items() if c not in (anchor, *scopes) and number(k)]
        found = []
        for column, formula, alias in (d for text in columns for d in directives(text)):
            inputs = [c.strip() for c in column.split("*")]
            if missing := [c for c in inputs if c not in kinds]:
                warnings.warn(f"{name}: no column {missing[0]}, {formula} left out", stacklevel=3)
                continue
            if formula not in FORMULAS:
                raise ValueError(f"{name}: unknown formula {formula}")
            for c in inputs:
                if (formula in NUMERIC and not number(kinds[c])) or (formula == "span_end" and not kinds[c].startswith("timestamp")):
                    raise ValueError(f"{name}: {formula} doesn't take {c} of type {kinds[c]}")
            found.append(Source(column, formula, alias, "double" if len(inputs) > 1 else kinds[column]))
        return found

    def register_tier(self, name: str, frame: str) -> None:
        """Adds a frame to a pipeline and builds its tier, from the next finer one where buckets nest."""
        def add(now: dict) -> dict:
            now["definition"]["frames"] += f",{frame}"
            return now

        self._manifest(self.pipeline(name)).change(add)
        self.refresh(name)

    def drop(self, name: str) -> None:
        """Forgets the pipeline and its log and deletes its files; a table that was left where it is stays."""
        self.files.delete(f"{self.path}/{name}")

    # reading

    def _manifest(self, p: Pipeline) -> Manifest:
        return Manifest(self.spark, p.path)

    def _read(self, folder: str, schema: T.StructType, commits: list[str]) -> DataFrame:
        both = T.StructType([*schema, T.StructField("__commit", T.StringType()), T.StructField("__part", T.IntegerType())])
        if not commits:
            return self.spark.createDataFrame([], both)
        return self.spark.read.schema(both).option("basePath", folder).parquet(*(f"{folder}/__commit={c}" for c in commits))

    def _base(self, p: Pipeline, numbers: list[int] | None = None) -> DataFrame:
        """Rows of the base table with __commit and __part; of the parts `numbers` only. A table left where it is has neither."""
        wanted = None if numbers is None else {str(n) for n in numbers}
        commits = [c for c, parts in p.state["base"].items() if wanted is None or wanted & parts.keys()]
        df = self._read(f"{p.path}/base", p.schema, commits)
        if numbers is not None:
            df = df.where(F.col("__part").isin(list(numbers)))
        for c, parts in p.state["hidden"].items():
            if c in commits:
                df = df.where((F.col("__commit") != c) | ~F.col("__part").isin(parts))
        if p.table:
            df = df.unionByName(as_utc(self.spark.read.parquet(p.table)).select(p.schema.fieldNames()).withColumns({"__commit": F.lit(None).cast("string"), "__part": F.lit(None).cast("int")}))
        return df

    def raw(self, name: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """The base table with __t, the time in whole seconds, and __us, in microseconds. With ranges, folders and row groups outside them are skipped."""
        p = self.pipeline(name)
        return self._raw(p, ranges)

    def _raw(self, p: Pipeline, ranges: list[tuple[int, int]] | None = None, numbers: list[int] | None = None) -> DataFrame:
        if ranges is not None and numbers is None:
            held = {int(n) for parts in p.state["base"].values() for n in parts}
            numbers = sorted(n for n in held if any(n * p.part < b and (n + 1) * p.part > a for a, b in ranges))
        df, kind = self._base(p, numbers), p.kinds[p.anchor]
        if ranges and kind in ("timestamp", "bigint"):  # said of the column itself, it reaches the Parquet scan
            of = F.timestamp_seconds if kind == "timestamp" else lambda x: x
            df = df.where(reduce(operator.or_, [(F.col(p.anchor) >= of(F.lit(a))) & (F.col(p.anchor) < of(F.lit(b))) for a, b in ranges]))
        us = F.col(p.anchor).cast("long") * 1_000_000 if kind == "bigint" else F.unix_micros(F.col(p.anchor).cast("timestamp"))
        return df.withColumns({"__t": epoch_seconds(F.col(p.anchor), kind), "__us": us})

    def tier(self, name: str, frame: str) -> DataFrame:
        p = self.pipeline(name)
        return self._tier(p, frame, p.state["tiers"][frame]).drop("__commit", "__part")

    def _tier(self, p: Pipeline, frame: str, parts: dict[str, list], only: list[int] | None = None) -> DataFrame:
        held: dict[str, list[int]] = {}
        for part, (commit, _) in parts.items():
            if only is None or int(part) in only:
                held.setdefault(commit, []).append(int(part))
        df = self._read(f"{p.path}/tier-{frame}", self._tier_schema(p), list(held))
        of = [(F.col("__commit") == c) & F.col("__part").isin(parts) for c, parts in held.items()]
        return df.where(reduce(operator.or_, of)) if of else df

    def _tier_schema(self, p: Pipeline) -> T.StructType:
        rows = self.spark.createDataFrame([], p.schema).withColumns({"__t": F.lit(0).cast("long"), "__us": F.lit(0).cast("long")})
        return self._lift(p, rows, [F.col("__t").alias("t"), *(F.col(c) for c in p.scopes)]).schema

    def reconstruct(self, name: str, frame: str) -> DataFrame:
        """A tier for reading: its time under the anchor's name as a timestamp, ends of spans as timestamps and as seconds from the bucket."""
        p = self.pipeline(name)
        ends = [s.alias for s in p.sources if s.formula == "span_end"]
        df = self.tier(name, frame).drop("__rows")
        offsets = {f"{e}_offset": span_offset(F.timestamp_micros(e), F.col("t")) for e in ends}
        return df.withColumns(offsets | {e: F.timestamp_micros(e) for e in ends} | {"t": F.timestamp_seconds("t")}).withColumnRenamed("t", p.anchor)

    # changes

    def touched(self, name: str, rows: DataFrame) -> DataFrame:
        """Distinct (scopes, start, end) of the smallest frame's buckets that rows fall in."""
        return self._touched(self.pipeline(name), rows)

    @staticmethod
    def _touched(p: Pipeline, rows: DataFrame) -> DataFrame:
        smallest = p.frames[0]
        t = epoch_seconds(F.col(p.anchor), dict(rows.dtypes)[p.anchor])
        starts = rows.where(F.col(p.anchor).isNotNull()).select(*p.scopes, smallest.bucket(t).alias("start")).distinct()
        return starts.withColumn("end", smallest.after(F.col("start")))

    def _log_change(self, p: Pipeline, rows: DataFrame) -> str:
        mark = uuid.uuid4().hex
        self._touched(p, rows).write.parquet(f"{p.path}/log/{mark}")
        return mark

    def _written(self, folder: str, df: DataFrame, order: list[str]) -> tuple[str, dict[str, int]]:
        """Writes df (with __part) as a new commit, sorted, each task a run of neighbouring parts; (commit, rows by part)."""
        commit = uuid.uuid4().hex
        to = f"{folder}/__commit={commit}"
        df.repartitionByRange("__part", *order).sortWithinPartitions("__part", *order).write.partitionBy("__part").parquet(to)
        counts = self.spark.read.schema("__part int").option("basePath", to).parquet(to).groupBy("__part").count().collect()
        return commit, {str(r["__part"]): r["count"] for r in counts}

    def _parted(self, p: Pipeline, rows: DataFrame) -> DataFrame:
        t = epoch_seconds(F.col(p.anchor), dict(rows.dtypes)[p.anchor])
        return rows.select(*p.schema.fieldNames(), F.coalesce(F.floor(t / p.part).cast("int"), F.lit(_TIMELESS)).alias("__part"))

    def _add(self, p: Pipeline, rows: DataFrame, log: bool = True, batch: tuple[str, int] | None = None) -> None:
        commit, parts = self._written(f"{p.path}/base", self._parted(p, rows), [p.anchor])
        mark = self._log_change(p, self._read(f"{p.path}/base", p.schema, [commit])) if log and parts else None

        def add(now: dict) -> dict | None:
            if batch:
                if now["batches"].get(batch[0], -1) >= batch[1]:
                    return None
                now["batches"][batch[0]] = batch[1]
            if parts:
                now["base"][commit] = parts
            now["log"] += [mark] if mark else []
            return now

        self._manifest(p).change(add)

    def insert(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds rows and marks their buckets dirty, in one version. batch: (stream, number); a number not above the last one is ignored."""
        p = self.pipeline(name)
        if batch and p.state["batches"].get(batch[0], -1) >= batch[1]:
            return
        self._add(p, rows, batch=batch)

    def delete(self, name: str, condition: Column) -> None:
        """Deletes rows of the base table: parts with such rows are written anew without them."""
        self._rewrite(name, condition, None)

    def update(self, name: str, condition: Column, values: dict[str, Column]) -> None:
        """Sets columns of the rows that meet the condition; their old and new buckets become dirty."""
        self._rewrite(name, condition, values)

    def _rewrite(self, name: str, condition: Column, values: dict[str, Column] | None) -> None:
        p = self.pipeline(name)
        if p.table:
            p = self._own(p)
        condition = F.coalesce(condition, F.lit(False))
        hit = self._base(p).where(condition)
        numbers = [r["__part"] for r in hit.select("__part").distinct().collect()]
        if not numbers:
            return
        here = self._base(p, numbers)
        cast = {c: v.cast(p.kinds[c]) for c, v in (values or {}).items()}
        changed = here.where(condition).select(*p.schema.fieldNames()).withColumns(cast) if values else None
        kept = here.where(~condition).select(*p.schema.fieldNames())
        commit, parts = self._written(f"{p.path}/base", self._parted(p, kept.unionByName(changed) if values else kept), [p.anchor])
        mark = self._log_change(p, hit.unionByName(changed, allowMissingColumns=True) if values else hit)
        before = p.state["base"]

        def swap(now: dict) -> dict:
            for c in before:
                gone = [d for d in numbers if now["base"].get(c, {}).pop(str(d), None) is not None]
                if gone:
                    now["hidden"][c] = now["hidden"].get(c, []) + gone
                if c in now["base"] and not now["base"][c]:
                    del now["base"][c]
                    now["hidden"].pop(c, None)
            if set(now["base"]) - set(before) and any(str(d) in now["base"][c] for c in set(now["base"]) - set(before) for d in numbers):
                raise Conflict(f"{name}: rows came into the parts that are written anew")
            if parts:
                now["base"][commit] = parts
            now["log"].append(mark)
            return now

        self._manifest(p).change(swap)
        self.vacuum(name)

    def _own(self, p: Pipeline) -> Pipeline:
        """Copies a table that was left where it is, as rows are to be changed."""
        rows = as_utc(self.spark.read.parquet(p.table)).select(p.schema.fieldNames())
        commit, parts = self._written(f"{p.path}/base", self._parted(p, rows), [p.anchor])

        def own(now: dict) -> dict:
            now["definition"]["table"], now["table_rows"], now["table_span"] = None, 0, None
            now["base"][commit] = parts
            return now

        self._manifest(p).change(own)
        return self.pipeline(p.name)

    def truncate(self, name: str) -> None:
        """Removes every row, all states and the log."""
        def empty(now: dict) -> dict:
            now["definition"]["table"], now["table_rows"], now["table_span"] = None, 0, None
            return now | {"base": {}, "hidden": {}, "tiers": {f: {} for f in now["tiers"]}, "log": []}

        self._manifest(self.pipeline(name)).change(empty)
        self.vacuum(name)

    def purge(self, name: str) -> None:
        """Forgets what is dirty; tiers stay as they are."""
        self._manifest(self.pipeline(name)).change(lambda now: now | {"log": []})

    def compact(self, name: str, most: int = 8) -> None:
        """Writes parts that lie in more than `most` commits anew, as one; nothing becomes dirty."""
        p = self.pipeline(name)
        held: dict[str, int] = {}
        for parts in p.state["base"].values():
            for d in parts:
                held[d] = held.get(d, 0) + 1
        numbers = [int(d) for d, n in held.items() if n > most]
        if not numbers:
            return
        own = self._base(p, numbers).where(F.col("__part").isNotNull())
        commit, parts = self._written(f"{p.path}/base", own.select(*p.schema.fieldNames(), "__part"), [p.anchor])

        def swap(now: dict) -> dict:
            for c in p.state["base"]:
                gone = [d for d in numbers if now["base"].get(c, {}).pop(str(d), None) is not None]
                if gone:
                    now["hidden"][c] = now["hidden"].get(c, []) + gone
                if c in now["base"] and not now["base"][c]:
                    del now["base"][c]
                    now["hidden"].pop(c, None)
            now["base"][commit] = parts
            return now

        self._manifest(p).change(swap)
        self.vacuum(name)

    def log(self, name: str) -> DataFrame:
        """Pending (scopes, start, end), as changes wrote them."""
        p = self.pipeline(name)
        return self._log(p, p.state["log"])

    def _log(self, p: Pipeline, marks: list[str]) -> DataFrame:
        schema = T.StructType([*(f for f in p.schema if f.name in p.scopes), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        return self.spark.read.schema(schema).parquet(*(f"{p.path}/log/{m}" for m in marks)) if marks else self.spark.createDataFrame([], schema)

    # refresh

    def _lift(self, p: Pipeline, rows: DataFrame, keys: list[Column]) -> DataFrame:
        order = F.struct(F.col("__us"), F.col(p.tie) if p.tie else F.lit(0))
        made = [(FORMULAS[s.formula].lift(s.value(), order) if s.formula == "candle" else FORMULAS[s.formula].lift(s.value())).alias(s.alias) for s in p.sources]
        return rows.groupBy(*keys).agg(*made, F.count("*").alias("__rows"))

    def _merge(self, p: Pipeline, states: DataFrame, keys: list[Column]) -> DataFrame:
        """States by key. Formulas that merge around a centre get it by a first aggregate over the same keys."""
        keyed = states.select(*keys, *(s.alias for s in p.sources), "__rows")
        names = keyed.columns[: len(keys)]
        if not names:
            keyed, names = keyed.withColumn("__all", F.lit(0)), ["__all"]
        centred = {s.alias: FORMULAS[s.formula].centre(F.col(s.alias)).alias(f"__c_{s.alias}") for s in p.sources if FORMULAS[s.formula].centre}
        if centred:
            centres = keyed.groupBy(*(F.col(n).alias(f"__k_{n}") for n in names)).agg(*centred.values())
            same = reduce(operator.and_, [F.col(n).eqNullSafe(F.col(f"__k_{n}")) for n in names])
            keyed = keyed.join(centres, same)
        merged = [(FORMULAS[s.formula].merge(F.col(s.alias), F.col(f"__c_{s.alias}")) if s.alias in centred else FORMULAS[s.formula].merge(F.col(s.alias))).alias(s.alias) for s in p.sources]
        return keyed.groupBy(*names).agg(*merged, F.sum("__rows").alias("__rows")).drop("__all")

    @staticmethod
    def _span(p: Pipeline, frame: Frame) -> int:
        """Seconds of states in one folder of the tier."""
        return p.part * (8 if frame.seconds and frame.seconds < DAY else 64)

    def _nests(self, p: Pipeline, below: Frame, frame: Frame) -> bool:
        """Whether every bucket of `below` lies in one of `frame`, over the whole time that rows have."""
        if frame.seconds:
            return below.seconds > 0 and frame.seconds % below.seconds == 0
        unit = {1: "month", 3: "quarter", 12: "year"}.get(frame.months)
        return p.span is not None and unit is not None and refines(below, unit, frame.zone, *p.span)

    def refresh(self, name: str, scope: dict | list[dict] | None = None) -> None:
        """Rebuilds dirty buckets, finest tier first; a tier that isn't there yet is built whole.

        scope, or several: only log entries of these are handled and taken off the log. Tiers and log change in one
        version after every tier is written, so a refresh that fails leaves all as it was.
        """
        p = self.pipeline(name)
        before, taken, rest = p.state["tiers"], p.state["log"], []
        missing = [f for f in p.frames if f.name not in before]
        if not taken and not missing:
            return
        log = self._log(p, taken)
        if scope is not None and not missing:
            scopes = scope if isinstance(scope, list) else [scope]
            mine = reduce(operator.or_, [reduce(operator.and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in s.items()], F.lit(True)) for s in scopes])
            if not log.where(mine).limit(1).count():
                return
            rest = [uuid.uuid4().hex]
            log.where(~mine).write.parquet(f"{p.path}/log/{rest[0]}")
            log = log.where(mine)
        fresh: dict[str, dict] = {}
        staged = f"{p.path}/staged-{uuid.uuid4().hex}"
        for i, frame in enumerate(p.frames):
            below = p.frames[i - 1] if i and self._nests(p, p.frames[i - 1], frame) else None
            if frame in missing:
                source = self._tier(p, below.name, fresh[below.name]) if below else self._raw(p)
                fresh[frame.name] = self._store(p, frame, self._states(p, frame, source, below))
            else:
                fresh[frame.name] = self._rebuilt(p, frame, below, fresh, log, f"{staged}/{frame.name}") if taken else before[frame.name]

        def swap(now: dict) -> dict:
            if now["tiers"] != before:
                raise Conflict(f"{name}: another refresh came in between")
            return now | {"tiers": fresh, "log": [m for m in now["log"] if m not in taken] + rest}

        self._manifest(p).change(swap)
        self.files.delete(staged)
        self.vacuum(name)

    def _states(self, p: Pipeline, frame: Frame, source: DataFrame, below: Frame | None) -> DataFrame:
        keys = [frame.bucket(F.col("t" if below else "__t")).alias("t"), *(F.col(c) for c in p.scopes)]
        return self._merge(p, source, keys) if below else self._lift(p, source.where(F.col("__t").isNotNull()), keys)

    def _store(self, p: Pipeline, frame: Frame, states: DataFrame) -> dict[str, list]:
        part = F.floor(F.col("t") / self._span(p, frame)).cast("int")
        commit, parts = self._written(f"{p.path}/tier-{frame.name}", states.withColumn("__part", part), ["t", *p.scopes])
        return {n: [commit, rows] for n, rows in parts.items()}

    def _rebuilt(self, p: Pipeline, frame: Frame, below: Frame | None, fresh: dict[str, dict], log: DataFrame, staged: str) -> dict[str, list]:
        """The tier's parts after its dirty buckets are computed again; other parts are not read."""
        starts = F.array_distinct(F.array(frame.bucket(F.col("start")), frame.bucket(F.col("end") - 1)))
        log.select(*(F.col(c).alias(f"__s_{c}") for c in p.scopes), F.explode(starts).alias("__b")).distinct().write.parquet(staged)
        spots = self.spark.read.schema(T.StructType([*(T.StructField(f"__s_{f.name}", f.dataType) for c in p.scopes for f in p.schema if f.name == c), T.StructField("__b", T.LongType())])).parquet(staged)
        numbers = lambda size: F.sequence(F.floor(F.col("__b") / size), F.floor((frame.after(F.col("__b")) - 1) / size))
        parts_of = lambda size: [r[0] for r in spots.select(F.explode(numbers(size))).distinct().collect()]  # noqa: E731  # as many as the time range has
        mine = [r[0] for r in spots.select(F.floor(F.col("__b") / self._span(p, frame))).distinct().collect()]
        source = self._tier(p, below.name, fresh[below.name], parts_of(self._span(p, below))) if below else self._raw(p, numbers=parts_of(p.part))
        hit = lambda t: reduce(operator.and_, [frame.bucket(F.col(t)) == F.col("__b"), *(F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in p.scopes)])
        again = self._states(p, frame, source.join(spots, hit("t" if below else "__t"), "left_semi"), below)
        old = self._tier(p, frame.name, p.state["tiers"][frame.name], mine).drop("__commit", "__part")
        made = self._store(p, frame, old.join(spots, hit("t"), "left_anti").unionByName(again))
        kept = {n: v for n, v in p.state["tiers"][frame.name].items() if int(n) not in mine}
        return kept | made

    def vacuum(self, name: str, older_than: int | None = None) -> list[str]:
        """Deletes commits and log files that no kept version names and that are older than the grace time; their paths."""
        p = self.pipeline(name)
        folder = f"{p.path}/manifest"
        versions = [json.loads(self.files.read(f"{folder}/{n}")) for n in self.files.names(folder) if n.endswith(".json")]
        if older_than == 0:
            versions = versions[-1:]
        used = {f"base/__commit={c}" for v in versions for c in v["base"]} | {f"log/{m}" for v in versions for m in v["log"]}
        used |= {f"tier-{f}/__commit={c}" for v in versions for f, parts in v["tiers"].items() for c, _ in parts.values()}
        limit = (time.time() - (self.config.grace if older_than is None else older_than)) * 1000
        gone = []
        for kind in ("base", "log", *(f"tier-{f.name}" for f in p.frames)):
            for name_ in self.files.names(f"{p.path}/{kind}"):
                path = f"{kind}/{name_}"
                if path not in used and self.files._fs.getFileStatus(self.files.path(f"{p.path}/{path}")).getModificationTime() <= limit:
                    self.files.delete(f"{p.path}/{path}")
                    gone.append(path)
        return gone

    # what there is

    def status(self, now: int) -> DataFrame:
        """By pipeline and scope: pending ranges and seconds, oldest and newest, lag to `now`."""
        logs = []
        for name in self.names():
            p = self.pipeline(name)
            if p.state["log"]:
                scope = F.to_json(F.struct(*p.scopes)) if p.scopes else F.lit("{}")
                logs.append(unify_intervals(self._log(p, p.state["log"]), p.scopes).select(F.lit(name).alias("base"), scope.alias("scope"), "start", "end"))
        log = reduce(DataFrame.unionByName, logs) if logs else self.spark.createDataFrame([], "base string, scope string, start long, end long")
        return log.groupBy("base", "scope").agg(F.count("*").alias("entries"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.min("start").alias("oldest"), F.max("end").alias("newest"), (F.lit(now) - F.min("end")).alias("lag"))

    def latest_changes(self, name: str, now: int, limit: int = 100) -> DataFrame:
        """Pending log entries, newest first, with their age; at most `limit`, and 500."""
        age = F.greatest(F.lit(0).cast("long"), F.lit(now) - F.col("end"))
        return self.log(name).withColumn("age", age).orderBy(F.desc("end"), *self.pipeline(name).scopes).limit(min(limit, 500))

    def follow_changes(self, name: str) -> DataFrame:
        """A stream of log entries as changes write them."""
        p = self.pipeline(name)
        schema = self._log(p, []).schema
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{p.path}/log")

    def metadata(self) -> DataFrame:
        """One row a view: the base table (frame null) and each tier, with its rows and columns."""
        rows = []
        for name in self.names():
            p = self.pipeline(name)
            rows.append((name, name, None, 0, p.anchor, p.scopes, p.rows))
            rows += [(name, f"{name}_{f.name}", f.name, f.order, "t", p.scopes, p.tier_rows.get(f.name)) for f in p.frames]
        return self.spark.createDataFrame(rows, "base string, view string, frame string, seconds long, time_column string, scopes array<string>, rows long")

    def available_sources(self) -> DataFrame:
        of = ((n, self.pipeline(n)) for n in self.names())
        return self.spark.createDataFrame([(n, f"{n}_{f.name}", s.column, s.formula, s.alias) for n, p in of for f in p.frames for s in p.sources], "base string, view string, column string, formula string, alias string")

    def storage(self) -> DataFrame:
        """Bytes and rows of every base table and tier."""
        rows = []
        for name in self.names():
            p = self.pipeline(name)
            rows.append((name, name, self.files.size(p.table or f"{p.path}/base"), p.rows))
            rows += [(name, f"{name}_{f}", self.files.size(f"{p.path}/tier-{f}"), n) for f, n in p.tier_rows.items()]
        return self.spark.createDataFrame(rows, "base string, view string, bytes long, rows long")

    def hierarchies(self) -> DataFrame:
        """By pipeline its views, the base table first and then by frame, each with sources and storage."""
        sources = self.available_sources().groupBy("view").agg(F.sort_array(F.collect_list(F.struct("alias", "column", "formula"))).alias("sources"))
        views = self.metadata().drop("rows").join(sources, "view", "left").join(self.storage().drop("base"), "view", "left")
        level = F.struct("seconds", "view", "frame", "sources", "bytes", "rows")
        return views.groupBy("base").agg(F.sort_array(F.collect_list(level)).alias("levels"))

    def blocks(self, name: str) -> DataFrame:
        """By folder of the base table: address range, rows, their first and last time, and pending buckets that reach into it."""
        p = self.pipeline(name)
        held = self._raw(p).where(F.col("__t").isNotNull()).groupBy(F.floor(F.col("__t") / p.part).alias("block")).agg(F.count("*").alias("rows"), F.min("__t").alias("first"), F.max("__t").alias("last"))
        days = F.explode(F.sequence(F.floor(F.col("start") / p.part), F.floor((F.col("end") - 1) / p.part))).alias("block")
        pending = self.log(name).select(days).groupBy("block").agg(F.count("*").alias("pending"))
        return held.join(pending, "block", "left").select("block", (F.col("block") * p.part).alias("start"), ((F.col("block") + 1) * p.part).alias("end"), "rows", "first", "last", F.coalesce("pending", F.lit(0).cast("long")).alias("pending"))

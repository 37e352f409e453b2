"""Pipelines over sessions, failures and replays; exact answers in odd zones and with large whole numbers."""

from __future__ import annotations

import warnings
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import engine as engine_module
from tidemark.operators.answers import Linear
from tidemark.operators.engine import Engine, EngineConfig
from tidemark.operators.manifest import Conflict, Manifest
from tidemark.sources.scratch import scratch
from tidemark.streaming.ingest import bootstrap, ingest, work

T0 = 1704103200  # 2024-01-01 10:00 UTC


def rows(spark, *data):
    """(seconds after T0, scope, value)."""
    return spark.createDataFrame([(T0 + t, k, float(v)) for t, k, v in data], "s long, k string, v double").select(F.timestamp_seconds("s").alias("t"), "k", "v")


def made(spark, *data, **how):
    e = Engine(spark, scratch(spark, "durable"), EngineConfig(worth=10.0))
    e.accelerate("x", rows(spark, *(data or ((5, "a", 10), (1200, "a", 20), (10, "b", 30)))), how.pop("frames", "1m,1h"), ["k"], ["v stats, sum as s"], **how)
    return e


def total(e, **how):
    return e.query("x", aggs=[("sum", "v", "s"), ("count", "*", "n")], **how).first()


def test_another_session_sees_the_pipeline(spark):
    e = made(spark)
    e.insert("x", rows(spark, (30, "a", 100)))
    other = Engine(spark, e.path, e.config)
    assert other.names() == ["x"] and other.log("x").count() == 1 and total(other)["s"] == 160.0
    other.refresh("x")
    assert total(e)["s"] == 160.0 and e.log("x").count() == 0 and {r["k"]: r["__rows"] for r in e.tier("x", "1h").collect()} == {"a": 3, "b": 1}
    assert other.accelerate("x", rows(spark, (0, "z", 1))).scopes == ["k"]  # what is there stays


def test_a_replayed_batch_adds_nothing(spark):
    e = made(spark)
    for number in (0, 0, 1, 0):
        e.insert("x", rows(spark, (30, "a", 100)), batch=("stream", number))
    assert total(e) == (260.0, 5)
    other = rows(spark, (40, "b", 1))
    other.write.parquet(path := scratch(spark, "arrivals"))
    stream = spark.readStream.schema(other.schema).parquet(path)
    for _ in range(2):  # the second finds nothing new
        ingest(e, "x", stream, scratch(spark, "checkpoint") if _ == 2 else f"{e.path}-checkpoint").awaitTermination()
    assert total(e) == (261.0, 6) and e.validate("x", "1h", T0, T0 + 3600).count() == 0


def test_a_failed_refresh_changes_nothing(spark, monkeypatch):
    e = made(spark)
    e.insert("x", rows(spark, (30, "a", 100)))
    version = e.pipeline("x").state["version"]
    store = Engine._store

    def fails(self, p, frame, states):
        if frame.name == "1h":
            raise RuntimeError("lost")
        return store(self, p, frame, states)

    monkeypatch.setattr(Engine, "_store", fails)
    with pytest.raises(RuntimeError):
        e.refresh("x")
    monkeypatch.undo()
    assert e.pipeline("x").state["version"] == version and e.log("x").count() == 1 and total(e)["s"] == 160.0
    e.refresh("x")
    assert total(e)["s"] == 160.0 and e.pipeline("x").state["version"] == version + 1
    before = e.pipeline("x").state
    e.refresh("x")  # nothing is dirty
    assert e.pipeline("x").state == before
    orphans = e.vacuum("x", older_than=0)
    assert orphans and total(e)["s"] == 160.0 and not e.vacuum("x", older_than=0)


def test_an_insert_during_a_refresh_stays_dirty(spark, monkeypatch):
    e = made(spark)
    e.insert("x", rows(spark, (30, "a", 100)))
    change = Manifest.change

    def late(self, how, tries=20):
        monkeypatch.undo()
        e.insert("x", rows(spark, (70, "b", 1000)))
        return change(self, how, tries)

    monkeypatch.setattr(Manifest, "change", late)
    e.refresh("x")
    assert [r["k"] for r in e.log("x").collect()] == ["b"] and total(e)["s"] == 1160.0
    e.refresh("x")
    assert e.log("x").count() == 0 and total(e)["s"] == 1160.0


def test_two_refreshes_at_once_conflict(spark, monkeypatch):
    e = made(spark)
    e.insert("x", rows(spark, (30, "a", 100)))
    change = Manifest.change

    def other_first(self, how, tries=20):
        monkeypatch.undo()
        Engine(spark, e.path, e.config).refresh("x")
        return change(self, how, tries)

    monkeypatch.setattr(Manifest, "change", other_first)
    with pytest.raises(Conflict):
        e.refresh("x")
    assert total(e)["s"] == 160.0


def test_a_refresh_reads_and_writes_dirty_parts_only(spark, monkeypatch):
    day = 86400
    e = made(spark, *((d * day, "a", d) for d in range(100)))
    p = e.pipeline("x")
    assert p.part == 4 * day and len(p.state["base"]) == 1
    seen = []
    raw = Engine._raw
    monkeypatch.setattr(Engine, "_raw", lambda self, *a, **how: seen.append(raw(self, *a, **how)) or seen[-1])
    e.insert("x", rows(spark, (50 * day + 5, "a", 1000)))
    old = {f: {c for c, _ in parts.values()} for f, parts in p.state["tiers"].items()}
    kept = {f: dict(parts) for f, parts in p.state["tiers"].items()}
    e.refresh("x")
    scanned = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "__part" in scanned.split("PartitionFilters: [")[1].split("]")[0]
    now = e.pipeline("x").state["tiers"]
    for f in ("1m", "1h"):
        fresh = {n for n, (c, _) in now[f].items() if c not in old[f]}
        assert len(fresh) == 1 and {n: v for n, v in now[f].items() if n not in fresh} == {n: v for n, v in kept[f].items() if n not in fresh}
    assert len(seen) == 1 and total(e)["s"] == sum(range(100)) + 1000
    monkeypatch.undo()
    late = [(r["t"], r["v_moments"]["n"]) for r in e.tier("x", "1h").where(F.col("v_moments.n") > 1).collect()]
    assert late == [(T0 + 50 * day, 2)]
    part = e.raw("x", [(T0 + 50 * day, T0 + 50 * day + 60)])
    pushed = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in pushed and "GreaterThanOrEqual(t," in pushed


def test_scopes_of_a_pipeline_loaded_later(spark):
    e = made(spark, initial_load=False)
    assert total(e)["s"] == 60.0 and e.log("x").count() == 3
    e.refresh("x", [{"k": "a"}])
    assert {r["k"] for r in e.tier("x", "1h").collect()} == {"a"} and {r["k"] for r in e.log("x").collect()} == {"b"} and total(e)["s"] == 60.0
    e.refresh("x", [{"k": "a"}, {"k": "none"}])
    e.refresh("x", [{"k": "b"}, {"k": "none"}])
    assert {r["k"] for r in e.tier("x", "1h").collect()} == {"a", "b"} and e.log("x").count() == 0


def test_update_delete_truncate_compact_purge(spark):
    e = made(spark)
    e.update("x", F.col("k") == "b", {"v": F.col("v") * 2, "k": F.lit("c")})
    assert {r["k"] for r in e.log("x").collect()} == {"b", "c"} and total(e) == (90.0, 3)
    e.refresh("x")
    assert {r["k"] for r in e.tier("x", "1m").collect()} == {"a", "c"} and total(e, scopes={"k": ["b", "c"]}) == (60.0, 1)
    e.delete("x", F.col("v") == 20)
    assert total(e) == (70.0, 2)
    e.delete("x", F.col("v") == 12345)
    for i in range(4):
        e.insert("x", rows(spark, (60 * i, "a", 1)))
    e.refresh("x")
    assert len(e.pipeline("x").state["base"]) == 5
    e.compact("x", 2)
    assert len(e.pipeline("x").state["base"]) == 1 and total(e) == (74.0, 6) and e.log("x").count() == 0
    e.insert("x", rows(spark, (60, "a", 1)))
    e.purge("x")
    assert e.log("x").count() == 0 and e.validate("x", "1m", T0, T0 + 3600).count() > 0
    e.truncate("x")
    assert total(e)["n"] == 0 and e.tier("x", "1h").count() == 0
    e.insert("x", rows(spark, (0, "a", 7)))
    e.refresh("x")
    assert total(e) == (7.0, 1)
    e.drop("x")
    assert e.names() == []


def test_a_table_that_stays_where_it_is(spark):
    rows(spark, (5, "a", 10), (1200, "a", 20), (10, "b", 30)).write.parquet(path := scratch(spark, "table"))
    e = Engine(spark, scratch(spark, "durable"), EngineConfig(worth=10.0))
    p = e.accelerate("x", path, "1m,1h", ["k"], ["v sum as s"])
    assert p.state["base"] == {} and total(e) == (60.0, 3)
    e.insert("x", rows(spark, (30, "a", 100)))
    assert total(e, start=T0, end=T0 + 600) == (140.0, 3)
    e.refresh("x")
    assert total(e) == (160.0, 4)
    e.delete("x", F.col("k") == "b")
    assert total(e) == (130.0, 3) and spark.read.parquet(path).count() == 3
    e.refresh("x")
    assert total(e) == (130.0, 3) and e.validate("x", "1h", T0, T0 + 3600).count() == 0


def test_months_in_a_zone_whose_offset_changed(spark):
    at = datetime(2023, 12, 31, 23, 30, tzinfo=timezone.utc).timestamp() - T0  # January in Algiers, where 1970 had no offset
    data = spark.createDataFrame([(T0 + int(at), 1.0), (T0, 2.0)], "s long, v double").select(F.timestamp_seconds("s").alias("t"), "v")
    e = Engine(spark, scratch(spark, "durable"), EngineConfig(zone="Africa/Algiers", worth=10.0))
    e.accelerate("x", data, "1d,1M", [], ["v sum as s"])
    assert [(r["t"], r["s"]["s"]) for r in e.tier("x", "1mo").collect()] == [(1704063600, 3.0)]


def test_sums_of_large_whole_numbers_are_exact_on_every_route(spark):
    big = (1 << 53) + 1
    data = spark.createDataFrame([(T0, big, Decimal("1.25")), (T0 + 1, 1, Decimal("2.50"))], "s long, v long, d decimal(10,2)").select(F.timestamp_seconds("s").alias("t"), "v", "d")
    e = Engine(spark, scratch(spark, "durable"), EngineConfig(worth=10.0))
    e.accelerate("x", data, "1m,1h", [], ["v sum as s, stats", "d sum as ds"])
    for start in (None, T0 - 7):
        tiers = e.query("x", start, None, [("sum", "v", "s"), ("avg", "v", "a"), ("sum", "d", "d"), ("avg", "d", "m")])
        mixed = e.query("x", start, None, [("sum", "v", "s"), ("avg", "v", "a"), ("sum", "d", "d"), ("avg", "d", "m"), ("count_distinct", "v", "k")])
        raw = data.agg(F.sum("v").alias("s"), F.avg("v").alias("a"), F.sum("d").alias("d"), F.avg("d").alias("m"))
        assert tiers.dtypes == raw.dtypes == mixed.dtypes[:4] and tiers.first() == mixed.first()[:4]
        got, want = tiers.first(), raw.first()
        assert (got["s"], got["d"], got["m"]) == (want["s"], want["d"], want["m"]) == (big + 1, Decimal("3.75"), Decimal("1.875"))
        assert got["a"] == (big + 1) / 2 and abs(got["a"] / want["a"] - 1) < 1e-15  # Spark's own average adds doubles


def test_linear_inputs_and_fallbacks(spark):
    e = made(spark, (0, "a", 1), (61, "a", 2), (3700, "b", 3))
    e.config = EngineConfig(worth=10.0)
    asked = [("sum", Linear("v", 2), "double"), ("sum", Linear("v", 1, 10), "plus"), ("avg", Linear("v", -1, 1), "mean"), ("min", Linear("v", -2), "low"), ("count", Linear("v", 5, 5), "n")]
    assert e.query("x", aggs=asked).first() == (12.0, 36.0, -1.0, -6.0, 3)
    assert e.query("x", aggs=[*asked, ("count_distinct", "v", "k")]).first() == (12.0, 36.0, -1.0, -6.0, 3, 3)
    sums = Engine(spark, scratch(spark, "durable"), EngineConfig(worth=10.0))
    sums.accelerate("x", rows(spark, (0, "a", 1), (1, "a", 5), (61, "a", 2)), "1m", ["k"], ["v sum as s"])
    assert sums.query("x", aggs=[("min", "v", "m"), ("avg", "v", "a")]).first() == (1.0, 8 / 3)  # never of bucket sums
    assert sums.query("x", aggs=[("sum", "v", "s")], where=F.col("v") > 1).first() == (7.0,)
    assert sums.plan("x", aggs=[("min", "v")])[1] == ["no tier column answers min(v)"]
    assert sums.query("x", aggs=[("sum", "v", "s")], ranges=[]).first() == (None,)
    assert "1x 1m" in sums.explain_slices("x") and "doesn't refine" in sums.explain_slices("x", grain="second")
    sums.config = EngineConfig(worth=0.1)
    assert "not worth it" in sums.explain_slices("x")
    sums.config = EngineConfig(worth=10.0, max_segments=0)
    assert "too many" in sums.explain_slices("x")


def test_quantiles_join_views_and_reports(spark):
    e = Engine(spark, scratch(spark, "durable"), EngineConfig(worth=10.0))
    e.accelerate("x", rows(spark, *((i, "a", v) for i, v in enumerate((5, 5, 5, 10)))), "1m,1h", ["k"], ["v sketch, sum as s"])
    e.accelerate("y", rows(spark, (1, "a", 7), (1, "b", 8)), "1m", ["k"], ["v sum as s"])
    assert e.quantiles("x", "v", {"low": 0, "mid": 0.5, "high": 0.9, "top": 1}).first() == (5.0, 5.0, 10.0, 10.0)
    joined = e.join(("x", [("sum", "v", "x")]), ("y", [("sum", "v", "y")]), scopes={"k": "a"}, by=["k"], grain="hour")
    assert joined.collect() == [(T0, "a", 25.0, 7.0)]
    e.create_view("sliced", "x", aggs=[("sum", "v", "s")], by=["k"])
    assert spark.sql("SELECT k, s + (SELECT max(s) FROM sliced) FROM sliced").collect() == [("a", 50.0)]
    spark.catalog.dropTempView("sliced")
    assert {r["view"]: r["rows"] for r in e.metadata().collect()} == {"x": 4, "x_1m": 1, "x_1h": 1, "y": 2, "y_1m": 2}
    assert all(r["bytes"] > 0 for r in e.storage().collect()) and [len(r["levels"]) for r in e.hierarchies().orderBy("base").collect()] == [3, 2]
    assert e.reconstruct("x", "1h").select(F.unix_seconds("t")).first() == (T0,)
    assert [r["v"] for r in e.rows("x", T0, T0 + 3, limit=2).collect()] == [5.0, 5.0]


def test_worker_status_and_lag(spark):
    e = made(spark)
    e.insert("x", rows(spark, (130, "a", 1), (60, "b", 1), (60, "b", 1)))
    got = {r["scope"]: tuple(r)[2:] for r in e.status(T0 + 1000).collect()}
    assert got == {'{"k":"a"}': (1, 60, T0 + 120, T0 + 180, 820), '{"k":"b"}': (1, 60, T0 + 60, T0 + 120, 880)}
    assert [(r["k"], r["age"]) for r in e.latest_changes("x", T0 + 1000, 1).collect()] == [("a", 820)]
    tail = e.follow_changes("x").writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    tail.awaitTermination()
    assert spark.table("tail").count() == 2
    assert work(e) == ["x"] and e.status(T0).count() == 0 and work(e) == []
    bootstrap(e, "x", 10, T0 + 3600, 3600, lambda df: df.select(F.col("timestamp").alias("t"), F.lit("g").alias("k"), F.col("value").cast("double").alias("v")))
    assert total(e, scopes={"k": "g"}) == (45.0, 10)


def test_directives_that_cant_be_used_are_told(spark):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        e = Engine(spark, scratch(spark, "durable"))
        p = e.accelerate("x", rows(spark, (0, "a", 1)), "1h", ["k"], ["v sum as s, what is this", "w sum"])
    assert [s.alias for s in p.sources] == ["s"] and len([w for w in said if "left out" in str(w.message)]) == 2
    with pytest.raises(ValueError, match="no time column"):
        e.accelerate("y", spark.createDataFrame([(1.0,)], "v double"))
    with pytest.raises(ValueError, match="doesn't take"):
        e.accelerate("y", rows(spark, (0, "a", 1)), columns=["k stats"])
    assert engine_module.DAY == 86400


def test_a_formula_of_ones_own(spark):
    from tidemark.functions.states import FORMULAS, Formula, register

    register(Formula("bits", lambda x: F.bit_or(x.cast("long")), F.bit_or, {"bits": lambda s: s}))
    try:
        e = Engine(spark, scratch(spark, "durable"), EngineConfig(worth=10.0))
        e.accelerate("x", rows(spark, (0, "a", 1), (1, "a", 4), (70, "b", 8)), "1m,1h", ["k"], ["v bits as b"])
        assert e.query("x", aggs=[("bits", "v", "b")]).first() == (13,)
    finally:
        del FORMULAS["bits"]


def test_spans_end_times_and_empty_tables(spark):
    data = spark.createDataFrame([(T0, T0 + 480), (T0 + 180, T0 + 720), (T0 + 3000, T0 + 3300)], "a long, b long").select(F.timestamp_seconds("a").alias("t"), F.timestamp_seconds("b").alias("ends"))
    e = Engine(spark, scratch(spark, "durable"))
    e.accelerate("x", data, "10m,1h", [], ["ends range_max_end as e"])
    assert sorted(r["e_offset"] for r in e.reconstruct("x", "10m").collect()) == [300, 720] and [r["e_offset"] for r in e.reconstruct("x", "1h").collect()] == [3300]
    e.accelerate("none", rows(spark, (0, "a", 1)).limit(0), "1m,1h", ["k"], ["v sum as s"])
    assert e.query("none", aggs=[("count", "*", "n")]).collect() == [(0,)] and e.query("none", aggs=[("count", "*", "n")], by=["k"]).count() == 0
    e.insert("none", rows(spark, (0, "a", 1), (0, None, 2)))
    e.refresh("none")
    assert sorted((str(r["k"]), r["n"]) for r in e.query("none", aggs=[("count", "*", "n")], by=["k"]).collect()) == [("None", 1), ("a", 1)]
    e.insert("none", rows(spark, (1, None, 5)))
    e.refresh("none")
    assert e.query("none", aggs=[("sum", "v", "s")], scopes={"k": None}).first() == (7.0,)

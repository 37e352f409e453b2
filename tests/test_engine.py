"""Frames, slices, states and pipelines on literal data with known answers."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.curves import morton3
from tidemark.functions.frames import parse_frames, refines
from tidemark.operators.engine import Engine, directives
from tidemark.plans.slices import RAW, Segment, slice_range, unify
from tidemark.sources.scratch import scratch

MINUTE, HOUR = parse_frames("1m,1h")


def at(text: str) -> int:
    return int(datetime.fromisoformat(f"2024-01-01T{text}+00:00").timestamp())


def test_frames():
    assert [f.name for f in parse_frames("1M,0h,1m,junk,90")] == ["1m", "90s", "1mo"]
    month = parse_frames("1M")[0]
    assert month.ceil(at("00:00:01")) == 1706745600 and month.floor(at("05:00")) == at("00:00")
    assert refines(HOUR, "day", "America/New_York", 0, 1 << 30) and not refines(HOUR, "day", "Asia/Kolkata", at("00:00"), at("12:00"))
    assert not refines(parse_frames("1w")[0], "week", "UTC", 0, 100)


def test_slices():
    assert slice_range((at("10:00:30"), at("11:05")), [MINUTE, HOUR], []) == [Segment(RAW, at("10:00:30"), at("10:01")), Segment("1m", at("10:01"), at("11:05"))]
    assert slice_range((at("10:00"), at("12:00")), [MINUTE, HOUR], [(at("10:30"), at("10:31"))]) == [Segment("1m", at("10:00"), at("10:30")), Segment(RAW, at("10:30"), at("10:31")), Segment("1m", at("10:31"), at("11:00")), Segment("1h", at("11:00"), at("12:00"))]
    assert unify([(180, 240), (0, 60), (60, 120), (200, 300)]) == [(0, 120), (180, 300)]
    assert directives("v stats, ohlcv as c, product(v, w)") == [("v", "moments", "v_moments"), ("v", "candle", "c"), ("v * w", "sum", "v_w_product")]


def rows(spark, *data):
    return spark.createDataFrame([(datetime.fromisoformat(f"2024-01-01T{t}"), k, float(v)) for t, k, v in data], "t timestamp, k string, v double")


def test_pipeline_refresh_and_scopes(spark):
    e = Engine(spark, scratch(spark, "test"))
    e.accelerate("x", rows(spark, ("10:00:05", "a", 10), ("10:20:00", "a", 20), ("10:00:10", "b", 30)), "1m,1h", ["k"], ["v stats, ohlcv as c"])
    with pytest.raises(ValueError):
        e.accelerate("y", rows(spark, ("10:00:05", "a", 10)), "1m", ["k"], ["k sum"])
    e.config = type(e.config)(worth=10.0)
    total = lambda **how: e.query("x", at("10:00"), at("11:00"), [("sum", "v", "s"), ("variance", "v", "d")], **how).collect()
    assert total() == [(60.0, 100.0)]
    e.insert("x", rows(spark, ("10:05:00", "a", 100), ("10:06:00", "b", 1)))
    assert total()[0]["s"] == 161.0 and e.log("x").count() == 2
    e.refresh("x", {"k": "a"})
    hour = {r["k"]: r["v_moments"]["n"] for r in e.tier("x", "1h").collect()}
    assert hour == {"a": 3, "b": 1} and [r["k"] for r in e.log("x").collect()] == ["b"]
    e.refresh("x")
    assert {r["k"]: r["v_moments"]["n"] for r in e.tier("x", "1h").collect()} == {"a": 3, "b": 2} and e.validate("x", "1h", 0, 1 << 33).count() == 0
    e.delete("x", F.col("k") == "b")
    e.refresh("x")
    assert e.tier("x", "1m").where("k = 'b'").count() == 0 and total(scopes={"k": "a"})[0]["s"] == 130.0
    assert "1x 1h" in e.explain_slices("x", at("10:00"), at("11:00"))
    e.drop("x")


def test_morton3_holds_42_bits_each(spark):
    top = (1 << 42) - 1
    data = [(0, 0, 0), (1, 2, 3), (1 << 20, 0, 0), (1 << 21, 1 << 20, 7), ((1 << 22) - 1, 1 << 41, 5), (top, 0, 0), (0, top, 0), (0, 0, top), (top, top, top), (123456789012, 987654321098, 55555555555)]
    want = lambda r, bits: sum((v >> i & 1) << 3 * i + k for i in range(bits) for k, v in enumerate(r))
    xyz = F.col("x"), F.col("y"), F.col("z")
    got = spark.createDataFrame(data, "x long, y long, z long").select(*xyz, morton3(*xyz).alias("code")).collect()
    assert all(r["code"] == f"{want(r[:3], 42):032X}" for r in got)
    assert len({r["code"] for r in got}) == len(data)

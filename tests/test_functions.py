"""States, curves and addresses on literal data: golden values, fixed vectors and small models in Python."""

from __future__ import annotations

import random


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import addressing, curves
from tidemark.functions.frames import from_epoch, trunc
from tidemark.functions.states import CANDLE, FORMULAS, MOMENTS, SKETCH, candle_array, candle_json, moments_of_count, moments_of_value, sketch_quantile
from tidemark.operators.intervals import unify_intervals
from tidemark.plans import catalogue

# fixed values: statistics of the numbers 0 to 999, 10000 and -5000
GOLDEN = {"count": 1002, "avg": 503.4930139720559, "variance": 203617.6567943035, "skewness": 7.4922857702305725, "kurtosis": 215.5949153892171, "min": -5000.0, "max": 10000.0}


def one(spark, sql: str):
    return spark.sql(sql)


def merged(states: DataFrame) -> DataFrame:
    centre = states.agg(MOMENTS.centre(F.col("s")).alias("c"))
    return states.crossJoin(centre).agg(MOMENTS.merge(F.col("s"), F.col("c")).alias("s"))


def answers(df: DataFrame) -> dict:
    return df.select(*(f(F.col("s")).alias(n) for n, f in MOMENTS.finals.items())).first().asDict()


def test_moments_merge_to_the_golden_values(spark):
    values = spark.createDataFrame([(float(v), i % 37) for i, v in enumerate([*range(1000), 10000, -5000])], "x double, part int")
    for shift in (0.0, 1e9):
        states = values.groupBy("part").agg(MOMENTS.lift(F.col("x") + shift).alias("s"))
        got = answers(merged(states))
        for name, want in GOLDEN.items():
            want += shift if name in ("avg", "min", "max") else 0
            assert abs(got[name] - want) <= abs(want) * (1e-12 if not shift else 1e-6), (shift, name)
    plan = merged(values.groupBy("part").agg(MOMENTS.lift(F.col("x")).alias("s")))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_moments_of_few_values(spark):
    states = lambda *groups: spark.createDataFrame([(float(x), g) for g, xs in enumerate(groups) for x in xs], "x double, g int").groupBy("g").agg(MOMENTS.lift(F.col("x")).alias("s"))
    got = answers(merged(states((10, 20), (30,))))
    assert (got["count"], got["avg"], got["variance"], got["skewness"]) == (3, 20.0, 100.0, 0.0) and abs(got["kurtosis"] + 1.5) < 1e-12
    assert answers(merged(states((10, 20, 30), (40, 50))))["variance"] == 250.0
    none = spark.createDataFrame([(None,), (None,)], "x double").agg(MOMENTS.lift(F.col("x")).alias("s"))
    got = answers(merged(none))
    assert (got["count"], got["avg"], got["sum"], got["variance"], got["kurtosis"]) == (0, None, None, 0.0, 0.0)
    r = spark.range(1).select(moments_of_count(F.lit(7)).alias("s"))
    assert answers(r)["count"] == 7
    r = spark.range(1).select(moments_of_value(F.lit(4.5)).alias("s"))
    assert (answers(r)["avg"], answers(r)["stddev"], answers(r)["skewness"], answers(r)["max"]) == (4.5, 0.0, 0.0, 4.5)


def test_candle(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate((100, 110, 105, 115, 112))], "i int, v double")
    whole = rows.agg(CANDLE.lift(F.col("v"), F.struct("i")).alias("s"))
    parts = rows.groupBy(F.col("i") % 2).agg(CANDLE.lift(F.col("v"), F.struct("i")).alias("s")).agg(CANDLE.merge(F.col("s")).alias("s"))
    for df in (whole, parts):
        got = df.select(candle_array(F.col("s")), candle_json(F.col("s"))).first()
        assert got[0] == [100.0, 115.0, 100.0, 112.0, 542.0] and got[1] == '{"open":100.0,"high":115.0,"low":100.0,"close":112.0,"volume":542.0,"count":5}'
    ties = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "t int, id int, v double").agg(CANDLE.lift(F.col("v"), F.struct("t", "id")).alias("s"))
    assert ties.select("s.open", "s.close").first() == (5.0, 6.0)


def test_sketch_quantiles(spark):
    rows = spark.createDataFrame([(float(v), v % 2) for v in (5, 5, 5, 10)], "v double, g int")
    merged_ = rows.groupBy("g").agg(SKETCH.lift(F.col("v")).alias("s")).agg(SKETCH.merge(F.col("s")).alias("s"))
    assert merged_.select(*(sketch_quantile(F.col("s"), q) for q in (-1, 0.5, 0.9, 1))).first() == (5.0, 5.0, 10.0, 10.0)
    wide = spark.range(100_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 50).alias("g"))
    got = wide.groupBy("g").agg(SKETCH.lift(F.col("v")).alias("s")).agg(SKETCH.merge(F.col("s")).alias("s")).select(*(sketch_quantile(F.col("s"), q) for q in (0.5, 0.95))).first()
    assert abs(got[0] - 50_000) < 3_000 and abs(got[1] - 95_000) < 3_000
    assert "quantile_sketch" in FORMULAS


def test_unify(spark):
    log = spark.createDataFrame([("A", 0, 60), ("A", 60, 120), ("A", 180, 240), ("A", 200, 300), ("B", 0, 60)], "k string, start long, end long")
    assert sorted(map(tuple, unify_intervals(log, ["k"]).collect())) == [("A", 0, 120), ("A", 180, 300), ("B", 0, 60)]
    rng = random.Random(1)
    data = [(a := rng.randrange(40_000_000), a + rng.randrange(1, 3_000_000)) for _ in range(60)]
    want = []
    for a, b in sorted(data):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert sorted(map(list, unify_intervals(spark.createDataFrame(data, "start long, end long"), []).collect())) == want
    open_ = spark.createDataFrame([(None, 5), (3, 9), (20, None)], "start long, end long")
    assert sorted(map(tuple, unify_intervals(open_, []).collect())) == [(-(1 << 62), 9), (20, 1 << 62)]


def weave(x: int, y: int) -> int:
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(64))


def hilbert(x: int, y: int, bits: int = 64) -> int:
    d = 0
    for i in range(bits - 1, -1, -1):
        a, b = x >> i & 1, y >> i & 1
        d += (3 * a ^ b) << 2 * i
        if b == 0:
            if a:
                x, y = ~x, ~y
            x, y = y, x
    return d


def test_curves(spark):
    rng = random.Random(2)
    data = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (3, 3), *((rng.getrandbits(rng.randrange(1, 63)), rng.getrandbits(rng.randrange(1, 63))) for _ in range(30)), (-1, -5)]
    x, y = F.col("x"), F.col("y")
    coded = spark.createDataFrame(data, "x long, y long").select("x", "y", curves.morton2(x, y).alias("z"), curves.hilbert2(x, y).alias("h"))
    back = coded.select("*", *(c.alias(n) for c, n in zip(curves.demorton2(F.col("z")), ("u", "v"), strict=True))).collect()
    for r in back:
        assert r["z"] == f"{weave(r['x'] % (1 << 64), r['y'] % (1 << 64)):032X}" and (r["u"], r["v"]) == (r["x"], r["y"])
        assert r["h"] == f"{hilbert(r['x'], r['y']):032X}"
    assert [int(r["h"], 16) for r in back[:7]] == [0, 1, 3, 2, 14, 4, 10]
    texts = spark.createDataFrame([("sensor_a", "region_eu"), (None, "é"), ("", "")], "a string, b string")
    got = texts.select(curves.fnv64(F.col("a")).alias("h"), curves.morton_text(F.lit(12345), [F.col("a"), F.col("b")]).alias("z")).collect()
    assert got[0]["h"] % (1 << 64) == 11461482958241160951 and int(got[0]["z"], 16) == 216013192613394168723479454144299839467
    assert got[1]["h"] is None and got[2]["h"] % (1 << 64) == 14695981039346656037
    r = spark.range(1).select(curves.spiral_box(F.lit(125), 60).alias("b"), curves.spiraling_code(F.lit(1), F.lit(2), F.lit(3)).alias("c")).first()
    assert tuple(r["b"]) == (5.0, 2.0, 15.0, 12.0) and len(r["c"]) == 32


def test_boxes(spark):
    assert curves.box_ranges(0, 0, 1, 1) == [(0, 3)] and curves.box_ranges(2, 0, 2, 0) == [(4, 4)]
    points = [(x, y) for x in range(20) for y in range(20)]
    for most in (8, 256):
        ranges = curves.box_ranges(3, 5, 11, 17, most=most)
        inside = {p for p in points if any(a <= weave(*p) <= b for a, b in ranges)}
        box = {(x, y) for x, y in points if 3 <= x <= 11 and 5 <= y <= 17}
        assert inside >= box and (most == 8 or inside == box)
    coded = spark.createDataFrame(points, "x long, y long").withColumn("z", curves.morton2(F.col("x"), F.col("y")))
    assert coded.where(curves.in_ranges(F.col("z"), curves.box_ranges(3, 5, 11, 17)) & curves.in_box(F.col("z"), 3, 5, 11, 17)).count() == 9 * 13


def _plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _made_by_batch(df: DataFrame) -> bool:
    """Codes are made for a batch of rows, not by thousands of terms for each row."""
    plan = _plan_of(df)
    return "lambda" not in plan and len(plan) < 5000


def test_box_of_codes_is_cut_by_batch(spark):
    data = [(-1, 0), (None, 3), (99, 20), (100, 20), (357, 90), (358, 90), (200, 55), (200, -1), (1 << 40, 30)]
    coded = spark.createDataFrame(data, "x long, y long").select("x", "y", curves.morton2(F.col("x"), F.col("y")).alias("z"))
    box = 100, 20, 357, 90
    cut = coded.where(curves.in_ranges(F.col("z"), curves.box_ranges(*box)) & curves.in_box(F.col("z"), *box))
    assert sorted(map(tuple, cut.select("x", "y").collect())) == [(100, 20), (200, 55), (357, 90)] and _made_by_batch(cut)
    overlapping = [(1, 9), (2, 3), (20, 20)]
    codes = spark.createDataFrame([(f"{v:032X}",) for v in (0, 1, 4, 9, 10, 20, 21)] + [(None,)], "z string")
    assert [r[0] for r in codes.select(curves.in_ranges(F.col("z"), overlapping)).collect()] == [False, True, True, True, False, True, False, None]
    assert not codes.where(curves.in_ranges(F.col("z"), [])).count()


def test_codes_are_decoded_by_batch(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    data = [(low, high), (high, low), (-1, 0), (0, -1), (1 << 31, 1 << 32)]
    x, y = curves.demorton2(curves.morton2(F.col("x"), F.col("y")))
    back = spark.createDataFrame(data + [(None, 1)], "x long, y long").select(x.alias("u"), y.alias("v"))
    assert [tuple(r) for r in back.collect()] == data + [(None, None)] and _made_by_batch(back)
    texts = spark.createDataFrame([("0" * 31,), ("é" * 16,), ("g" * 32,), ("0" * 31 + "f",)], "z string")
    assert [tuple(r) for r in texts.select(*curves.demorton2(F.col("z"))).collect()] == [(None, None)] * 3 + [(3, 3)]


def test_hilbert_codes_are_made_by_batch(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    data = [(low, high), (high, low), (low, low), (high, high), (-1, 0), (0, -1), (1704067200, 149)]
    coded = spark.createDataFrame(data + [(None, 1), (1, None)], "x long, y long").select(curves.hilbert2(F.col("x"), F.col("y")).alias("h"))
    want = [f"{hilbert(*p):032X}" for p in data] + [None, None]
    assert [r["h"] for r in coded.collect()] == want and _made_by_batch(coded)


def test_codes_of_three_are_made_by_batch(spark):
    high = (1 << 42) - 1
    data = [(high, 0, 0), (0, high, 0), (0, 0, high), (-1, -1, -1), (1 << 42, 1 << 20, 1 << 21), (5, 7, 1)]
    coded = spark.createDataFrame(data + [(None, 1, 1)], "x long, y long, z long").select(curves.morton3(F.col("x"), F.col("y"), F.col("z")).alias("c"))
    want = [f"{sum((v >> i & 1) << 3 * i + k for k, v in enumerate(p) for i in range(42)):032X}" for p in data] + [None]
    assert [r["c"] for r in coded.collect()] == want and _made_by_batch(coded)


def test_addresses(spark):
    epochs = [(0, 16, 0), (2678400, 128, 42854746)]
    points = spark.createDataFrame([(100, 5), (2678408, 7), (2678400 - 1, 15), (-1, 3)], "t long, n long")
    at = addressing.epoch_slot(F.col("t"), F.col("n"), epochs)
    t, n = addressing.epoch_address(F.col("slot"), epochs)
    got = points.withColumn("slot", at).withColumns({"t2": t, "n2": n}).collect()
    assert got[1]["slot"] == 42855777 and all((r["t"], r["n"]) == (r["t2"], r["n2"]) for r in got)
    r = spark.range(1).select(addressing.slot(F.lit(100), F.lit(5), 1024).alias("s")).select("s", *addressing.block(F.col("s"))).first()
    assert tuple(r) == (102405, 201, 96)
    rows = spark.createDataFrame([(0, 0, 10.0), (0, 1, 11.0), (1, 0, 20.0), (1, 1, 21.0), (100, 5, 99.0), (-1, 0, 1.0), (1, 1024, 1.0)], "t long, tenant long, value double")
    packed = addressing.pack_slots(rows, 1024)
    assert sorted(map(tuple, addressing.scan_slots(packed, 1024).collect())) == [(0, 0, 10.0), (0, 1, 11.0), (1, 0, 20.0), (1, 1, 21.0), (100, 5, 99.0)]
    assert addressing.read_slot(packed, 100, 5, 1024).collect() == [(99.0,)] and not addressing.read_slot(packed, 7, 7, 1024).collect()
    assert dict(addressing.pack_slots(rows, 1024, compact=True).dtypes) == {"slot": "bigint", "t": "int", "value": "float"}
    blocks = addressing.pack_blocks(rows.where("t >= 0"))
    assert sorted(map(tuple, addressing.scan_blocks(blocks).collect())) == sorted(map(tuple, rows.where("t >= 0").collect()))
    assert addressing.read_block_point(blocks, 100, 5).collect() == [(99.0,)] and addressing.read_block(blocks, 0, 1).count() == 2
    stats = {r["page"]: r for r in addressing.page_stats(packed, 1024).collect()}
    assert (stats[0]["rows"], stats[0]["dense"], stats[2]["dense"], stats[201]["first_t"], stats[201]["last_tenant"]) == (2, True, True, 100, 5)


def _events_in(spark, folder, rows) -> str:
    data = [(i, t, user, "click", value, "") for i, t, user, value in rows]
    made = spark.createDataFrame(data, "event_id long, t double, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_page_fill_counts_every_row(spark, tmp_path):
    jan = float(catalogue.JAN)
    rows = [(0, jan + 1.5, 0, 1.0), (1, jan, 1024, 2.0), (2, jan + 1, 9000, 3.0), (3, None, 5, 4.0), (4, jan + 1, None, 5.0), (5, jan + 5, 1023, 6.0)]
    got = sorted(map(tuple, catalogue.page_fill(spark, _events_in(spark, tmp_path, rows)).collect()), key=str)
    assert got == sorted([(1024 // 509, 2), (10024 // 509, 1), (6143 // 509, 1), (None, 2)], key=str)


def test_point_reads_find_their_event(spark, tmp_path):
    jan = float(catalogue.JAN)
    others = [(1, jan + 9, 2000, 1.0), (2, jan + 10, 976, 2.0)]  # same second and user, and same slot
    three = lambda *values: sorted((k, v) for k in ("slot", "compact", "block") for v in values)
    cases = [([(77, jan + 9.25, 2000, 7.5)], three(7.5)), ([(77, None, 5, 8.5)], three(8.5)), ([(77, jan + 9, None, None)], three(None)), ([], [])]
    cases.append(([(77, jan + 9, 2000, 7.5), (77, jan + 99, 3, 7.5)], three(7.5, 7.5)))
    for i, (mine, want) in enumerate(cases):
        got = catalogue.point_reads(spark, _events_in(spark, tmp_path / str(i), others + mine)).collect()
        assert sorted(map(tuple, got)) == want, i


def test_times(spark):
    rows = spark.createDataFrame([(1710043200,), (1710127800,), (1710131400,)], "t long")  # 2024-03-10 04:00, 03-11 03:30 and 04:30 UTC
    days = [str(r[0])[:16] for r in rows.select(from_epoch(trunc("day", F.col("t"), "America/New_York"))).collect()]
    assert days == ["2024-03-09 05:00", "2024-03-10 05:00", "2024-03-11 04:00"]

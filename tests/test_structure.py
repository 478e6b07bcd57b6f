"""Levels, structure, zones and profiles against brute force on small series, whatever the size of blocks and the fan of the tree."""

import random

import pytest
from pyspark.sql import functions as F

from ohlspark.operators import extensions as X
from ohlspark.operators import overlays as O
from ohlspark.operators.series import indexed

BARS = "series string, time timestamp_ntz, open double, high double, low double, close double, volume double"


def made(spark, n=300, seed=3, jump=3.0):
    rnd, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price = max(1.0, price + rnd.uniform(-jump, jump))
        close = round(price + rnd.uniform(-1, 1), 2)
        rows.append(("s", i, round(price, 2), round(max(price, close) + rnd.random(), 2), round(min(price, close) - rnd.random(), 2), close, float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, "series string, at int, open double, high double, low double, close double, volume double")
    df = df.withColumn("time", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("at"))))
    return indexed(df.drop("at")), rows


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_first_bar_above_at_any_height_of_the_tree(spark, fan):
    rnd = random.Random(fan)
    values = [rnd.randint(0, 60) for _ in range(290)] + [100]
    bars = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series string, idx long, value double")
    levels = [("s", i, float(rnd.choice([v, 60, 99, 100])), i) for i, v in enumerate(values) if i % 7 == 0]
    got = {r.level_idx: r.at for r in X.first_above(spark.createDataFrame(levels, "series string, level_idx long, price double, after long"), bars, fan).collect()}
    assert got == {k: next((j for j in range(after + 1, len(values)) if values[j] > price), None) for _, k, price, after in levels}


@pytest.mark.parametrize(("fan", "jump"), [(2, 3), (4, 40), (256, 40)])
def test_first_bar_that_meets_a_range_that_may_be_jumped_over(spark, fan, jump):
    rnd, price, rows = random.Random(jump), 100.0, []
    for i in range(200):
        price += rnd.uniform(-jump, jump)
        rows.append(("s", i, price - 0.5, price + 0.5))
    bars = spark.createDataFrame(rows, "series string, idx long, low double, high double")
    levels = [("s", k, b := rnd.uniform(60, 140), b + rnd.uniform(0, 2), rnd.randrange(150)) for k in range(60)]
    df = spark.createDataFrame(levels, "series string, k long, bottom double, top double, after long")
    hit = lambda low, high: (low <= F.col("top")) & (high >= F.col("bottom"))
    got = {r.k: r.at for r in X.first_hit(df, bars, hit, False, fan).collect()}
    assert got == {k: next((i for _, i, low, high in rows[after + 1 :] if low <= top and high >= bottom), None) for _, k, bottom, top, after in levels}


def test_whatever_the_blocks(spark, monkeypatch):
    bars, _ = made(spark)
    with_atr = bars.withColumn("atr", F.lit(4.0))
    everything = {
        "breaks": lambda: rows_of(X.weighted_breaks(bars), "idx", "type", "side", "price", "sweep_idx", "sweep_kind", "weight"),
        "zones": lambda: rows_of(X.mitigated_zones(bars, fan=3), "idx", "zone", "mitigated_idx", "filled_idx", "bottom_left", "top_left", "reaction"),
        "swings": lambda: rows_of(X.swing_points(bars), "idx", "type", "price"),
        "equal": lambda: rows_of(X.equal_swings(with_atr, within=40), "type", "idx", "earlier_idx"),
        "profile": lambda: rows_of(X.grown_area(X.spread_profile(X.segments(bars, "STRUCTURE"), 1.0)), "segment", "poc", "val", "vah"),
    }
    whole = {k: f() for k, f in everything.items()}
    assert all(whole.values()) and {r[6] for r in whole["breaks"]} > {1.0}
    monkeypatch.setattr(X, "BLOCK", 16)
    for k, f in everything.items():
        assert f() == whole[k], k


def test_equal_swings_and_levels_equal_brute_force(spark):
    bars, _ = made(spark, 400)
    atr = lambda i: 1.0 + (i % 5)
    given = bars.withColumn("atr", 1.0 + F.col("idx") % 5)
    swings = [(r.type, r.idx, r.price) for r in X.swing_points(bars).collect()]
    want = {("EQ" + a[0][0], a[1], b[1]) for a in swings for b in swings if a[0] == b[0] and b[1] < a[1] <= b[1] + 60 and abs(a[2] - b[2]) <= 0.1 * atr(a[1])}
    pairs = X.equal_swings(given, within=60)
    assert {(r.type, r.idx, r.earlier_idx) for r in pairs.collect()} == want and pairs.count() == len(want) > 10
    up = {(t, i): max(e for u, j, e in want if (u, j) == (t, i)) for t, i, _ in want}
    root = lambda t, i: root(t, up[t, i]) if (t, i) in up else i
    members = {(t, k, root(t, k)) for t, i in up for k in (i, up[t, i])}
    levels = {}
    for t, k, r in members:
        levels.setdefault((t, r), []).append(k)
    assert {(r.type, r.level_idx): (r.n, r.last_idx) for r in X.equal_levels(pairs).collect()} == {k: (len(v), max(v)) for k, v in levels.items()}
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and X.equal_levels(pairs.limit(0)).count() == 0


def test_profiles_keep_the_volume(spark):
    bars, rows = made(spark)
    total = sum(r[6] for r in rows)
    for mode in X.PROFILES:
        profile = X.spread_profile(X.segments(bars, mode), 2.0)
        assert abs(profile.agg(F.sum("volume")).first()[0] - total) < 1e-6
        area = X.grown_area(profile).collect()
        assert all(r.val <= r.poc <= r.vah and r.inside >= 0.7 * r.volume - 1e-6 for r in area) and abs(sum(r.volume for r in area) - total) < 1e-6
    assert len(X.segments(bars, "STRUCTURE").select("segment").distinct().collect()) == X.structure_breaks(bars).count() + 1
    flat = spark.createDataFrame([("s", 0, 5.0, 5.0, 7.0), ("s", 0, 4.0, 2.0, 8.0)], "series string, segment long, high double, low double, volume double")
    assert rows_of(X.spread_profile(flat, 2.0), "bin", "volume") == [(1, 8.0), (2, 7.0)]
    with pytest.raises(ValueError):
        X.segments(bars, "WEEK")


def test_an_overlay_of_a_user_and_lives_cut_to_the_view(spark):
    class Noon(O.Overlay):
        def render(self, view):
            rows = self.alive(spark.createDataFrame([("s", 10, 250), ("s", 295, None), ("s", 1, 20)], "series string, a long, b long"), view, "a", "b")
            return O.M.marks_of(rows, "price", "noon", F.col("cut_from"), self.y(F.lit(1.0)), F.col("cut_to"), None, F.lit("#fff"))

    bars, _ = made(spark)
    got = O.overlay_marks(bars, [Noon()], 100)
    assert rows_of(got, "kind", "x1", "x2") == [("noon", 200.0, 250.0), ("noon", 295.0, 299.0)]
    drawn = O.full_frame(bars.withColumn("atr", F.lit(2.0)).withColumn("time_text", F.col("time").cast("string")), [Noon()], 100)
    assert {"noon", "body", "last"} <= {r.kind for r in drawn.select("kind").distinct().collect()}
    with pytest.raises(NotImplementedError):
        O.overlay_marks(bars, [O.Overlay()])

"""Registered queries over the driver's tables and the SQL they are held against.

Computed doubles are rounded to six digits on both sides, as sums differ in their last bits by order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.functions.scalars import direction, eq_tolerance, number, round_half_away, tick_quantise
from ohlspark.functions.scale import Scale, atr_scale, price_scale
from ohlspark.operators import extensions as X
from ohlspark.operators import marks as M
from ohlspark.operators import overlays as O
from ohlspark.operators import view as V
from ohlspark.operators.folds import in_blocks
from ohlspark.operators.indicators import REGISTRY, Registry, true_range, wilder_atr, with_repeated_last
from ohlspark.operators.ranges import atr_range, price_range
from ohlspark.operators.resample import active, build_timeframes, followed_timeframes, merge_deltas, resample, resample_runs
from ohlspark.operators.series import bar_at, bar_slice, half_open_slice, indexed, size, time_anchors, timestamps
from ohlspark.schema import ANCHOR_TYPES
from ohlspark.streaming.live import latest_bars, live_atr, live_timeframes, live_upserts
from ohlspark.sources.bars import complete, event_bars, ingest, lineitem_bars, load, order_bars, passing_folder, read_bars, read_csv, settled, typed_bars, write_bars

QUERIES = {}
SQL = {}

OHLCV = ["time", "open", "high", "low", "close", "volume"]


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles, and no minus zero."""
    return df.select(*(F.round(F.col(c), digits).alias(c) + F.lit(0.0) if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


def bars_1m(spark: SparkSession, d: str) -> DataFrame:
    return indexed(event_bars(spark, d))


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("time"))


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("time_text", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


# --- SQL parts

_agg = "arg_min({p}, {o}) AS open, max({p}) AS high, min({p}) AS low, arg_max({p}, {o}) AS close, {v} AS volume"


def _bars(minutes: int = 1, keys: str = "") -> str:
    return f"SELECT {keys}time_bucket(INTERVAL '{minutes} minutes', ts) AS time, {_agg.format(p='value', o='(ts, event_id)', v='count(*)::DOUBLE')} FROM events GROUP BY ALL"


def _idx(source: str = "b", by: str = "") -> str:
    return f"SELECT *, row_number() OVER ({by} ORDER BY time) - 1 AS idx, lag(close) OVER ({by} ORDER BY time) AS pc FROM {source}"


BASE = f"b AS ({_bars()}), x AS ({_idx()})"
TR = "greatest(high - low, abs(high - {pc}), abs(low - {pc}))"
FRESH = TR.format(pc="coalesce(pc, 0)")
ATR = """s AS (SELECT sum(tr) / 14 AS v FROM t WHERE idx < 14),
r AS (SELECT 13::BIGINT AS idx, v AS atr FROM s UNION ALL SELECT r.idx + 1, (r.atr * 13 + t.tr) / 14 FROM r JOIN t ON t.idx = r.idx + 1),
a AS (SELECT idx, atr FROM r UNION ALL SELECT t.idx, s.v FROM t, s WHERE t.idx < 13)"""
WITH_ATR = f"WITH RECURSIVE {BASE}, t AS (SELECT *, {FRESH} AS tr FROM x), {ATR}"
COUNT = "n AS (SELECT count(*) AS n FROM x)"


# --- bars

for _tf, _m in (("1m", 1), ("5m", 5), ("15m", 15)):
    query(f"SELECT * FROM ({_bars(_m)})", f"bars_{_tf}")(lambda spark, d, m=_m: event_bars(spark, d, m).select(OHLCV))


@query(f"SELECT * FROM ({_bars(15)})")
def bars_15m_cascade(spark, d):
    return resample(event_bars(spark, d, 5), "15m").select(OHLCV)


@query(f"WITH RECURSIVE {BASE} SELECT time_bucket(INTERVAL '5 minutes', time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM b GROUP BY 1")
def bars_5m_from_1m(spark, d):
    return resample(event_bars(spark, d), "5m").select(OHLCV)


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tx FROM events),
k AS (SELECT *, left(tx, 14) || printf('%02d', (substr(tx, 15, 2)::INT // 5) * 5) || substr(tx, 17) AS key FROM e),
m AS (SELECT *, CASE WHEN lag(key) OVER (ORDER BY seq) = key THEN 0 ELSE 1 END AS brk FROM k),
g AS (SELECT *, sum(brk) OVER (ORDER BY seq) - 1 AS run FROM m)
SELECT run::BIGINT AS run, key AS time, arg_min(value, seq) AS open, max(value) AS high, min(value) AS low, arg_max(value, seq) AS close, count(*)::DOUBLE AS volume FROM g GROUP BY 1, 2""")
def bars_5m_islands(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    one = e.select(F.lit("all").alias("series"), "ts", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), *(F.col("value").alias(c) for c in OHLCV[1:5]), F.lit(1.0).alias("volume"))
    return resample_runs(one, "5m", ["ts", "event_id"], F.date_trunc("hour", "ts")).select("run", *OHLCV)


@query(f"SELECT l_shipdate AS time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM (SELECT l_shipdate, {_agg.format(p='l_extendedprice / l_quantity', o='(l_orderkey, l_linenumber, l_partkey, l_suppkey)', v='sum(l_quantity)')} FROM lineitem GROUP BY 1)")
def bars_daily_lineitem(spark, d):
    return rounded(lineitem_bars(spark, d).select(OHLCV))


@query(f"SELECT o_orderdate AS time, {_agg.format(p='o_totalprice', o='o_orderkey', v='count(*)::DOUBLE')} FROM orders GROUP BY 1")
def bars_daily_orders(spark, d):
    return order_bars(spark, d).select(OHLCV)


# --- accessors and windows

@query(f"WITH {BASE} SELECT count(*) AS n, count(*) - 1 AS last_idx, max(time) AS time, arg_max(close, idx) AS close FROM x")
def bar_count_last(spark, d):
    return size(bars_1m(spark, d)).select("n", "last_idx", "last.time", "last.close")


@query(f"WITH {BASE} SELECT idx, time, open, high, low, close, volume FROM x WHERE idx = 17")
def bar_at_17(spark, d):
    return bar_at(bars_1m(spark, d), 17.9).select("idx", *OHLCV)


@query(f"WITH {BASE} SELECT idx, time, open, high, low, close, volume FROM x WHERE idx BETWEEN 0 AND 40")
def bar_slice_inclusive(spark, d):
    return bar_slice(bars_1m(spark, d), -3, 40.7).select("idx", *OHLCV)


@query(f"WITH {BASE}, {COUNT} SELECT idx, time FROM x, n WHERE idx BETWEEN n - 100 AND n - 1")
def bar_timestamps(spark, d):
    return timestamps(M.viewed(bars_1m(spark, d), 100))


_anchors = "SELECT idx AS index, strftime(time, '%H:%M') AS label, minute(time)::INT AS minute FROM x"


@query(f"WITH {BASE} {_anchors}", "time_anchors")
def _time_anchors(spark, d):
    return time_anchors(bars_1m(spark, d).withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")))


@query(f"WITH {BASE} {_anchors} WHERE false")
def time_anchors_space(spark, d):
    """Times without a T have no anchor."""
    return time_anchors(with_text(bars_1m(spark, d)).withColumn("time", F.col("time_text")))


def _window(name: str, visible: float, offset: float, lo: str, hi: str) -> None:
    def run(spark, d):
        return M.viewed(bars_1m(spark, d), visible, offset).select("idx", "time", "close")

    query(f"WITH {BASE}, {COUNT} SELECT idx, time, close FROM x, n WHERE idx BETWEEN {lo} AND {hi}", name)(run)


_window("window_default", 100, 0, "n - 100", "n - 1")
_window("window_reset", 150, 0, "n - 150", "n - 1")
_window("window_overscroll", 100, -5, "n - 95", "n - 1")
_window("window_fractional", 133.1, 0, "trunc(n - 133.1)", "n - 1")


# --- indicators

@query(f"WITH {BASE} SELECT idx, round({FRESH}, 6) AS tr FROM x", "true_range")
def _true_range(spark, d):
    return rounded(bars_1m(spark, d).select("idx", true_range().alias("tr")))


@query(f"WITH {BASE} SELECT idx, round(CASE WHEN pc IS NULL THEN high - close ELSE {TR.format(pc='pc')} END, 6) AS tr FROM x")
def true_range_reset(spark, d):
    return rounded(bars_1m(spark, d).select("idx", true_range("reset").alias("tr")))


@query(f"{WITH_ATR} SELECT idx, round(atr, 6) AS atr FROM a")
def atr14(spark, d):
    return rounded(REGISTRY.values("ATR", bars_1m(spark, d)).select("idx", "atr"))


@query(f"WITH RECURSIVE {BASE}, t AS (SELECT *, CASE WHEN pc IS NULL THEN high - close ELSE {TR.format(pc='pc')} END AS tr FROM x), {ATR} SELECT idx, round(atr, 6) AS atr FROM a")
def atr14_reset(spark, d):
    return rounded(wilder_atr(bars_1m(spark, d), first="reset").select("idx", "atr"))


@query(SQL["atr14_reset"])
def atr14_after_reset(spark, d):
    """A registry that was put back: its ATR starts from no close at all."""
    indicators = Registry()
    indicators.register("ATR", wilder_atr, lambda bars: wilder_atr(bars, first="reset"))
    indicators.reset_all()
    return rounded(indicators.values("ATR", bars_1m(spark, d)).select("idx", "atr"))


@query(f"""WITH RECURSIVE {BASE}, y AS (SELECT idx, high, low, pc FROM x UNION ALL SELECT idx + 1, high, low, close FROM x WHERE idx = (SELECT max(idx) FROM x)),
t AS (SELECT *, {FRESH} AS tr FROM y), {ATR} SELECT idx, round(atr, 6) AS atr FROM a""")
def atr14_dup_tail(spark, d):
    return rounded(wilder_atr(with_repeated_last(bars_1m(spark, d))).select("idx", "atr"))


@query(f"""WITH RECURSIVE b AS ({_bars(1, 'event_type, ')}), x AS ({_idx(by='PARTITION BY event_type')}), t AS (SELECT *, {FRESH} AS tr FROM x),
s AS (SELECT event_type, sum(tr) / 14 AS v FROM t WHERE idx < 14 GROUP BY 1),
r AS (SELECT event_type, 13::BIGINT AS idx, v AS atr FROM s UNION ALL SELECT r.event_type, r.idx + 1, (r.atr * 13 + t.tr) / 14 FROM r JOIN t ON t.idx = r.idx + 1 AND t.event_type = r.event_type)
SELECT event_type AS series, idx, round(atr, 6) AS atr FROM r UNION ALL SELECT t.event_type, t.idx, round(s.v, 6) FROM t JOIN s USING (event_type) WHERE t.idx < 13""")
def atr14_by_event_type(spark, d):
    return rounded(wilder_atr(indexed(event_bars(spark, d, by_type=True))).select("series", "idx", "atr"))


@query(f"""{WITH_ATR}, f AS ({_bars(5)}), fx AS ({_idx('f')}) SELECT fx.idx, fx.time, round(a.atr, 6) AS atr FROM fx LEFT JOIN a ON a.idx = fx.idx""")
def atr_on_5m_reference(spark, d):
    """Values of one-minute bars at the positions of five-minute bars, as after a switch of timeframe."""
    values = wilder_atr(bars_1m(spark, d)).select("series", "idx", "atr")
    return rounded(indexed(event_bars(spark, d, 5)).join(values, ["series", "idx"], "left").select("idx", "time", "atr"))


@query(f"""WITH RECURSIVE b AS ({_bars(5)}), x AS ({_idx()}), t AS (SELECT *, {FRESH} AS tr FROM x), {ATR} SELECT x.idx, x.time, round(a.atr, 6) AS atr FROM x LEFT JOIN a ON a.idx = x.idx""")
def atr_on_5m_corrected(spark, d):
    return rounded(wilder_atr(indexed(event_bars(spark, d, 5))).select("idx", "time", "atr"))


@query(f"{WITH_ATR} SELECT idx, round(atr, 6) AS atr FROM a WHERE idx >= 0 AND idx < 20")
def atr_slice_half_open(spark, d):
    return rounded(half_open_slice(wilder_atr(bars_1m(spark, d)).select("idx", "atr"), -4, 20))


# --- ranges, scales and marks

_W = "w AS (SELECT x.* FROM x, n WHERE idx BETWEEN n - 100 AND n - 1)"
_P = "p0 AS (SELECT min(low) AS a0, max(high) AS b0 FROM w), p AS (SELECT a0 - (b0 - a0) * 0.05 AS y_min, b0 + (b0 - a0) * 0.05 AS y_max FROM p0)"
_PRICE = f"WITH {BASE}, {COUNT}, {_W}, {_P}"
_VW = "w AS (SELECT a.* FROM a, n WHERE idx BETWEEN n - 100 AND n - 1)"
_VP = "p0 AS (SELECT greatest(min(atr), 0) AS a0, max(atr) AS b0 FROM w), p AS (SELECT greatest(a0 - (b0 - a0) * 0.05, 0) AS y_min, b0 + (b0 - a0) * 0.05 AS y_max FROM p0)"
_ATR = f"{WITH_ATR}, {COUNT}, {_VW}, {_VP}"


@query(f"{_PRICE} SELECT round(y_min, 6) AS y_min, round(y_max, 6) AS y_max FROM p")
def price_range_auto(spark, d):
    return rounded(price_range(M.viewed(bars_1m(spark, d), 100)))


@query(f"{_ATR} SELECT round(y_min, 6) AS y_min, round(y_max, 6) AS y_max FROM p")
def atr_range_auto(spark, d):
    return rounded(atr_range(M.viewed(wilder_atr(bars_1m(spark, d)), 100)))


@query(f"WITH {BASE} SELECT idx, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM x")
def bar_direction(spark, d):
    return bars_1m(spark, d).select("idx", direction(F.col("open"), F.col("close")).alias("direction"))


ENDS = ("end_idx", "y_min", "y_max")


def price_view(spark: SparkSession, d: str) -> tuple[DataFrame, Scale]:
    window = M.viewed(bars_1m(spark, d), 100)
    end, low, high = map(F.col, ENDS)
    return M.with_row(window, price_range(window)), price_scale(end, 100, low, high)


def atr_view(spark: SparkSession, d: str) -> tuple[DataFrame, Scale]:
    window = M.viewed(wilder_atr(bars_1m(spark, d)), 100)
    end, low, high = map(F.col, ENDS)
    return M.with_row(window, atr_range(window)), atr_scale(end, 100, low, high)


_Y = "(385 - ({} - y_min) / (y_max - y_min) * 370)"
_X = "((idx - (n - 100)) * 8.0::DOUBLE + 4.0::DOUBLE)"


@query(f"""{_PRICE} SELECT idx, round({_X}, 4) AS x, round({_Y.format('high')}, 4) AS y_high, round({_Y.format('low')}, 4) AS y_low, round({_X} - 3.2::DOUBLE, 4) AS x1, round({_X} + 3.2::DOUBLE, 4) AS x2,
round(least({_Y.format('open')}, {_Y.format('close')}), 4) AS y_top, round(greatest({_Y.format('open')}, {_Y.format('close')}), 4) AS y_bottom, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM w, p, n""")
def candle_marks(spark, d):
    return rounded(M.candle_marks(*price_view(spark, d)), 4)


_AY = "(160 - (atr - y_min) / (y_max - y_min) * 160)"


@query(f"""{_ATR}, q AS (SELECT idx, {_X} AS x2, {_AY} AS y2 FROM w, p, n), l AS (SELECT idx, lag(x2) OVER (ORDER BY idx) AS x1, lag(y2) OVER (ORDER BY idx) AS y1, x2, y2 FROM q)
SELECT idx, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM l WHERE x1 IS NOT NULL""")
def atr_polyline(spark, d):
    return rounded(M.polyline(*atr_view(spark, d), "atr"), 4)


_FW = "wf AS (SELECT a.*, n - 133.1::DOUBLE AS first FROM a, n WHERE idx BETWEEN trunc(n - 133.1::DOUBLE) AND n - 1), p0 AS (SELECT greatest(min(atr), 0) AS a0, max(atr) AS b0 FROM wf), p AS (SELECT greatest(a0 - (b0 - a0) * 0.05, 0) AS y_min, b0 + (b0 - a0) * 0.05 AS y_max FROM p0)"


@query(f"""{WITH_ATR}, {COUNT}, {_FW}, q AS (SELECT idx, (idx + first - trunc(first) - first) * (800 / 133.1::DOUBLE) + 400 / 133.1::DOUBLE AS x2, {_AY} AS y2 FROM wf, p, n WHERE idx + first - trunc(first) <= n - 1),
l AS (SELECT idx, lag(x2) OVER (ORDER BY idx) AS x1, lag(y2) OVER (ORDER BY idx) AS y1, x2, y2 FROM q) SELECT idx, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM l WHERE x1 IS NOT NULL""")
def atr_polyline_fractional(spark, d):
    """The ATR line of a view of 133.1 bars, whose points stand a fraction of a bar right of them and end before the last."""
    window = M.viewed(wilder_atr(bars_1m(spark, d)), 133.1)
    end, low, high = map(F.col, ENDS)
    return rounded(M.polyline(M.with_row(window, atr_range(window)), atr_scale(end, 133.1, low, high), "atr", F.col("first_idx"), end), 4)


@query(f"{_PRICE} SELECT idx, round({_Y.format('close')}, 6) AS y, printf('%.2f', close) AS label, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM w, p, n WHERE idx = n - 1")
def last_price_mark(spark, d):
    return rounded(M.last_price_mark(*price_view(spark, d)))


@query(f"{_ATR} SELECT idx, round({_AY}, 6) AS y, printf('%.4f', atr) AS label FROM w, p, n WHERE idx = n - 1")
def last_atr_mark(spark, d):
    return rounded(M.last_atr_mark(*atr_view(spark, d), F.col("end_idx")))


def _grid_sql(height: int) -> str:
    return f"""g1 AS (SELECT *, (y_max - y_min) / greatest(2, {height} / 50.0) AS raw FROM p), g2 AS (SELECT *, pow(10.0, floor(log10(raw))) AS mag FROM g1),
g3 AS (SELECT *, CASE WHEN raw / mag < 1.5 THEN 1 WHEN raw / mag < 3 THEN 2 WHEN raw / mag < 7 THEN 5 ELSE 10 END * mag AS step FROM g2),
g4 AS (SELECT *, CASE WHEN trunc(y_min / step) * step < y_min THEN trunc(y_min / step) * step + step ELSE trunc(y_min / step) * step END AS first FROM g3),
g5 AS (SELECT step, first, unnest(generate_series(0, floor((y_max - first) / step + 1e-9)::BIGINT)) AS n FROM g4)
SELECT n, round(first + n * step, 9) AS value, CASE WHEN step >= 0.01 THEN printf('%.2f', round(first + n * step, 9)) ELSE printf('%.4f', round(first + n * step, 9)) END AS label FROM g5"""


@query(f"{_PRICE}, {_grid_sql(400)}")
def price_grid(spark, d):
    return M.grid(price_range(M.viewed(bars_1m(spark, d), 100)), 400)


@query(f"{_ATR}, {_grid_sql(160)}")
def atr_grid(spark, d):
    return M.grid(atr_range(M.viewed(wilder_atr(bars_1m(spark, d)), 100)), 160)


def _labels(visible: int) -> None:
    step = M.label_step(visible)
    near = max(1, step // 4)

    def run(spark, d):
        return M.axis_labels(M.viewed(with_text(bars_1m(spark, d)), visible), F.col("first_idx"), visible)

    query(f"""WITH {BASE}, {COUNT}, w AS (SELECT idx, n, strftime(time, '%Y-%m-%d %H:%M:%S') AS tx FROM x, n WHERE idx BETWEEN n - {visible} AND n - 1),
c AS (SELECT *, coalesce(left(tx, 10) <> lag(left(tx, 10)) OVER (ORDER BY idx), false) AS ch FROM w),
k AS (SELECT *, max(ch::INT) OVER (ORDER BY idx ROWS BETWEEN {near} PRECEDING AND {near} FOLLOWING) AS crowded FROM c)
SELECT (idx - (n - {visible}))::DOUBLE AS rel_index, tx AS timestamp, ch AS is_day_change, CASE WHEN ch THEN (substr(tx, 9, 2)::INT)::VARCHAR ELSE substr(tx, 12, 5) END AS label
FROM k WHERE ch OR (idx % {step} = 0 AND crowded = 0)""", f"axis_labels_{visible}")(run)


_labels(100)
_labels(600)


def cursors(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("cursor_id"), (F.col("id") * 20.5).alias("x"), (F.col("id") * 9.75 + 10).alias("y"))


_CURSOR = "c AS (SELECT i AS cursor_id, i * 20.5 AS x, i * 9.75 + 10 AS y FROM range(40) t(i)), k AS (SELECT cursor_id, y, (trunc(x / 8.0 + 0.5) + n - 100)::BIGINT AS idx FROM c, n)"


@query(f"""{_PRICE}, {_CURSOR} SELECT cursor_id, k.idx, CASE WHEN time IS NOT NULL THEN strftime(time, '%d %b %Y %H:%M') END AS time_label, printf('%.2f', trunc((y_min + (385 - y) / 370 * (y_max - y_min)) / 0.25 + 0.5) * 0.25) AS price_label FROM k LEFT JOIN x ON x.idx = k.idx CROSS JOIN p""")
def crosshair_pick(spark, d):
    bars = with_text(bars_1m(spark, d))
    row = M.with_row(M.view_bounds(bars, 100, 0), price_range(M.viewed(bars, 100)))
    return M.crosshair(bars, M.with_row(cursors(spark), row), price_scale(*(F.col(c) if c != "visible" else 100 for c in ("end_idx", "visible", "y_min", "y_max"))))


@query(f"{_ATR}, c AS (SELECT i AS cursor_id, i * 20.5::DOUBLE AS x, i * 4.0::DOUBLE AS y FROM range(40) t(i)) SELECT cursor_id, x, y, printf('%.4f', y_min + (160 - y) / 160 * (y_max - y_min)) AS atr_label FROM c, p")
def atr_crosshair(spark, d):
    window, scale = atr_view(spark, d)
    row = M.with_row(M.view_bounds(bars_1m(spark, d), 100, 0), atr_range(window))
    return M.atr_crosshair(M.with_row(cursors(spark).select("cursor_id", "x", (F.col("cursor_id") * 4.0).alias("y")), row), scale)


@query(f"WITH {BASE}, {COUNT} SELECT event_id, round(value * 8 / 8.0::DOUBLE + n - 100, 6) AS index_float, trunc(value * 8 / 8.0::DOUBLE + 0.5)::BIGINT + n - 100 AS index FROM events, n")
def cursor_positions(spark, d):
    """Where many cursors point on the axis of bars, exactly and rounded."""
    row = M.view_bounds(bars_1m(spark, d), 100, 0)
    scale, x = price_scale(F.col("end_idx"), 100, 0, 1), F.col("value") * 8
    rows = M.with_row(spark.read.parquet(f"{d}/events.parquet"), row)
    return rounded(rows.select("event_id", scale.index_float(x).alias("index_float"), scale.index(x).cast("long").alias("index")))


@query("SELECT event_id, value * 1.5::DOUBLE AS y, CASE WHEN value * 1.5::DOUBLE < 400 THEN 'price' WHEN value * 1.5::DOUBLE < 560 THEN 'atr' END AS panel FROM events")
def active_panel(spark, d):
    """The panel under each of many cursors, taken from the events."""
    y = F.col("value") * 1.5
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", y.alias("y"), M.active_panel(y).alias("panel"))


@query(f"{_PRICE}, {_CURSOR} SELECT cursor_id, k.idx FROM k JOIN w ON w.idx = k.idx, p WHERE y BETWEEN least({_Y.format('high')}, {_Y.format('low')}) - 5 AND greatest({_Y.format('high')}, {_Y.format('low')}) + 5")
def hover_hits(spark, d):
    window, scale = price_view(spark, d)
    row = M.with_row(M.view_bounds(bars_1m(spark, d), 100, 0), price_range(window))
    return M.hover_hits(window, M.with_row(cursors(spark), row), scale)


_LABEL100 = f"""lw AS (SELECT idx, n, strftime(time, '%Y-%m-%d %H:%M:%S') AS tx FROM x, n WHERE idx BETWEEN n - 100 AND n - 1),
lc AS (SELECT *, coalesce(left(tx, 10) <> lag(left(tx, 10)) OVER (ORDER BY idx), false) AS ch FROM lw), lk AS (SELECT *, max(ch::INT) OVER (ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS crowded FROM lc)"""
_GRID_LINES = lambda height, y: _grid_sql(height).replace("SELECT n, round", "SELECT y_min, y_max, n, round").replace("SELECT step, first, unnest", "SELECT y_min, y_max, step, first, unnest")


@query(f"""{WITH_ATR}, {COUNT}, {_W}, {_P}, wa AS (SELECT a.* FROM a, n WHERE idx BETWEEN n - 100 AND n - 1),
pa0 AS (SELECT greatest(min(atr), 0) AS a0, max(atr) AS b0 FROM wa), pa AS (SELECT greatest(a0 - (b0 - a0) * 0.05, 0) AS y_min, b0 + (b0 - a0) * 0.05 AS y_max FROM pa0), {_LABEL100},
gp AS (WITH {_GRID_LINES(400, "")}), ga AS (WITH {_GRID_LINES(160, "").replace("FROM p)", "FROM pa)")}),
c AS (SELECT idx, {_X} AS cx, {_Y.format('high')} AS yh, {_Y.format('low')} AS yl, least({_Y.format('open')}, {_Y.format('close')}) AS yt, greatest({_Y.format('open')}, {_Y.format('close')}) AS yb, CASE WHEN close >= open THEN '#26a69a' ELSE '#ef5350' END AS color FROM w, p, n),
sg AS (SELECT {_X} AS x2, 160 - (atr - y_min) / (y_max - y_min) * 160 AS y2, idx FROM wa, pa, n), sl AS (SELECT lag(x2) OVER (ORDER BY idx) AS x1, lag(y2) OVER (ORDER BY idx) AS y1, x2, y2 FROM sg),
u AS (SELECT 'price' AS panel, 'wick' AS kind, cx AS x1, yh AS y1, cx AS x2, yl AS y2, color, NULL::VARCHAR AS text FROM c
UNION ALL SELECT 'price', 'body', cx - 3.2::DOUBLE, yt, cx + 3.2::DOUBLE, yb, color, NULL FROM c
UNION ALL SELECT 'atr', 'line', x1, y1, x2, y2, '#75bbfd', NULL FROM sl WHERE x1 IS NOT NULL
UNION ALL SELECT 'price', 'grid', 0, {_Y.format('value')}, 800, {_Y.format('value')}, '#1f2933', NULL FROM gp UNION ALL SELECT 'price', 'grid_label', 37, {_Y.format('value')}, NULL, NULL, '#787b86', label FROM gp
UNION ALL SELECT 'atr', 'grid', 0, 160 - (value - y_min) / (y_max - y_min) * 160, 800, 160 - (value - y_min) / (y_max - y_min) * 160, '#1f2933', NULL FROM ga UNION ALL SELECT 'atr', 'grid_label', 37, 160 - (value - y_min) / (y_max - y_min) * 160, NULL, NULL, '#787b86', label FROM ga
UNION ALL SELECT 'time', 'time_label', {_X}, 12, NULL, NULL, CASE WHEN ch THEN '#000000' ELSE '#4b4b4c' END, CASE WHEN ch THEN (substr(tx, 9, 2)::INT)::VARCHAR ELSE substr(tx, 12, 5) END FROM lk WHERE ch OR (idx % 5 = 0 AND crowded = 0)
UNION ALL SELECT 'price', 'last', 0, {_Y.format('close')}, 800, {_Y.format('close')}, CASE WHEN close >= open THEN '#26a69a' ELSE '#ef5350' END, printf('%.2f', close) FROM w, p, n WHERE idx = n - 1
UNION ALL SELECT 'atr', 'last', 0, 160 - (atr - y_min) / (y_max - y_min) * 160, 800, 160 - (atr - y_min) / (y_max - y_min) * 160, '#75bbfd', printf('%.4f', atr) FROM wa, pa, n WHERE idx = n - 1
UNION ALL SELECT 'price', 'cross_h', 0, 150, 800, 150, '#9598a1', printf('%.2f', trunc((y_min + (385 - 150) / 370::DOUBLE * (y_max - y_min)) / 0.25 + 0.5) * 0.25) FROM p
UNION ALL SELECT 'atr', 'cross_h', 0, 50, 800, 50, '#9598a1', printf('%.4f', y_min + (160 - 50) / 160::DOUBLE * (y_max - y_min)) FROM pa
UNION ALL SELECT panel, 'cross_v', x, 0, x, h, '#9598a1', NULL FROM (VALUES ('price', 300, 400), ('price', 400, 400), ('atr', 300, 160), ('atr', 400, 160)) v(panel, x, h)
UNION ALL SELECT 'time', 'cross_time', cx, 12, NULL, NULL, '#9598a1', strftime(time, '%d %b %Y %H:%M') FROM (VALUES (300), (400)) v(cx), n, x WHERE x.idx = trunc(cx / 8.0 + 0.5) + n - 100)
SELECT panel, kind, round(x1::DOUBLE, 4) AS x1, round(y1::DOUBLE, 4) AS y1, round(x2::DOUBLE, 4) AS x2, round(y2::DOUBLE, 4) AS y2, color, text FROM u""")
def frame(spark, d):
    """All marks of the default view in one table, with a cursor in either panel."""
    rows = spark.range(2).select(F.col("id").alias("cursor_id"), (F.col("id") * 100 + 300).cast("double").alias("x"), (F.col("id") * 300 + 150).cast("double").alias("y"))
    return rounded(M.frame(wilder_atr(with_text(bars_1m(spark, d))), cursors=rows), 4)


@query(f"WITH {BASE} SELECT idx, trunc(close / 0.25 + 0.5) * 0.25 AS price FROM x", "tick_quantise")
def _tick_quantise(spark, d):
    return bars_1m(spark, d).select("idx", tick_quantise(F.col("close")).alias("price"))


@query(f"{WITH_ATR} SELECT idx, round(atr * 0.10, 6) AS tolerance FROM a", "eq_tolerance")
def _eq_tolerance(spark, d):
    return rounded(wilder_atr(bars_1m(spark, d)).select("idx", eq_tolerance(F.col("atr")).alias("tolerance")))


RECORDED = "CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE CASE WHEN event_id % 5 = 0 THEN 5 ELSE 0 END END"
_BOUNDED = "least(greatest({o}, -({v} - 2)), n - 2)"


@query(f"""WITH RECURSIVE {BASE}, {COUNT}, ac AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, {RECORDED} AS code, value - 50 AS arg, n::DOUBLE AS n FROM events, n),
st AS (SELECT user_id, -1 AS step, 100::DOUBLE AS visible, 0::DOUBLE AS shift FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, step, visible, CASE code WHEN 2 THEN {_BOUNDED.format(o='shift', v='visible')} ELSE shift END FROM (
SELECT ac.user_id, ac.step, code, n, CASE code WHEN 2 THEN greatest(2, CASE WHEN arg > 0 THEN st.visible - greatest(1, st.visible * 0.1::DOUBLE) ELSE st.visible + greatest(1, st.visible * 0.1::DOUBLE) END)
WHEN 4 THEN CASE WHEN arg = 0 THEN st.visible ELSE floor(greatest(2, st.visible * (1 - 0.005::DOUBLE * arg)) + 0.5) END WHEN 5 THEN 150 ELSE st.visible END AS visible,
CASE code WHEN 0 THEN CASE WHEN shift < n - 2 THEN shift + 1 ELSE shift END WHEN 1 THEN CASE WHEN shift > -(st.visible - 2) THEN shift - 1 ELSE shift END
WHEN 3 THEN CASE WHEN trunc(arg / (800 / st.visible)) <> 0 THEN {_BOUNDED.format(o='shift + trunc(arg / (800 / st.visible))', v='st.visible')} ELSE shift END WHEN 5 THEN 0 ELSE shift END AS shift
FROM st JOIN ac ON ac.user_id = st.user_id AND ac.step = st.step + 1))
SELECT user_id, step::BIGINT AS step, round(visible, 6) AS visible, round(shift, 6) AS "offset" FROM st WHERE step >= 0""")
def recorded_views(spark, d):
    """Each user's events as the actions of a session on the chart of all events, and the view after each."""
    e = spark.read.parquet(f"{d}/events.parquet")
    actions = e.select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("seq"), F.col("value").alias("close"), F.expr(RECORDED).cast("double").alias("code"), (F.col("value") - 50).alias("arg"))
    n = event_bars(spark, d).agg(F.count("*").cast("double").alias("n"))
    views = in_blocks(V.Recorded(), M.with_row(indexed(actions), n))
    return rounded(views.select(F.col("series").cast("long").alias("user_id"), F.col("idx").alias("step"), "visible", "offset"))


SESSIONS = [("zoom", [1, 400, True]), ("zoom", [-1]), ("pan", [120]), ("pan", [3]), ("press", ["Left"]), ("press", ["Right"]), ("drag_time_axis", [20]), ("drag_time_axis", [0]), ("set_timeframe", ["5m"]), ("set_timeframe", ["7m"])]
_BOUND = "least(greatest({}::DOUBLE, -({} - 2)::DOUBLE), n - 2)"


@query(f"""WITH {BASE}, s AS (SELECT n::DOUBLE AS n FROM (SELECT count(*) AS n FROM x UNION ALL SELECT * FROM range(4))), a(k, action, visible, tf) AS (VALUES
(0, 'zoom', 90, '1m'), (1, 'zoom', 110, '1m'), (2, 'pan', 100, '1m'), (3, 'pan', 100, '1m'), (4, 'press', 100, '1m'), (5, 'press', 100, '1m'), (6, 'drag_time_axis', 90, '1m'), (7, 'drag_time_axis', 100, '1m'), (8, 'set_timeframe', 150, '5m'), (9, 'set_timeframe', 150, '1m'))
SELECT n::BIGINT || ' ' || k AS session, action, visible::DOUBLE AS visible, tf,
round(CASE k WHEN 0 THEN {_BOUND.format(5, 90)} WHEN 1 THEN {_BOUND.format(0, 110)} WHEN 2 THEN {_BOUND.format(15, 100)} WHEN 4 THEN CASE WHEN 0 < n - 2 THEN 1 ELSE 0 END WHEN 5 THEN -1 ELSE 0 END, 6)::DOUBLE AS "offset" FROM s, a""")
def view_reducers(spark, d):
    """One action of each kind on new views of series of several sizes: the real one and 0 to 3 bars."""
    n = event_bars(spark, d).agg(F.count("*").alias("n")).unionByName(spark.range(4).select(F.col("id").alias("n")))
    actions = spark.createDataFrame([(k, a, json.dumps(args)) for k, (a, args) in enumerate(SESSIONS)], "k int, action string, args string")
    rows = n.join(F.broadcast(actions)).select(F.concat_ws(" ", "n", "k").alias("session"), F.lit(0).cast("long").alias("step"), "n", "action", "args")
    return V.traces(rows).select("session", "action", "visible", "tf", F.round("offset", 6).alias("offset"))


TRACE = [("zoom", [1, 400, True]), ("zoom", [-1]), ("pan", [120]), ("press", ["Left"]), ("press", ["Right"]), ("drag_time_axis", [20]), ("set_auto", [False, [0.0, 5.0], [10.0, 20.0]]), ("vertical_zoom", [1.0]), ("vertical_pan", [40.0]), ("drag_value_axis", [-10.0]), ("set_timeframe", ["5m"])]


@query("""SELECT * FROM (VALUES (0, 'zoom', 90.0::DOUBLE, 5.0::DOUBLE, true, 0.0::DOUBLE, 100.0::DOUBLE, '1m'), (1, 'zoom', 99.0, 5.0, true, 0.0, 100.0, '1m'), (2, 'pan', 99.0, 19.0, true, 0.0, 100.0, '1m'), (3, 'press', 99.0, 20.0, true, 0.0, 100.0, '1m'),
(4, 'press', 99.0, 19.0, true, 0.0, 100.0, '1m'), (5, 'drag_time_axis', 89.0, 19.0, true, 0.0, 100.0, '1m'), (6, 'set_auto', 89.0, 19.0, false, 10.0, 20.0, '1m'), (7, 'vertical_zoom', 89.0, 19.0, false, 9.5, 20.5, '1m'),
(8, 'vertical_pan', 89.0, 19.0, false, 10.6, 21.6, '1m'), (9, 'drag_value_axis', 89.0, 19.0, false, 10.875, 21.325, '1m'), (10, 'set_timeframe', 150.0, 0.0, true, NULL, NULL, '5m')) t(step, action, visible, "offset", auto, y_min, y_max, tf)""")
def view_reducer_trace(spark, d):
    """The states of a view of many bars under one action of each kind after the other; values worked out by hand."""
    n = event_bars(spark, d).agg(F.count("*").alias("n"))
    actions = spark.createDataFrame([(k, a, json.dumps(args)) for k, (a, args) in enumerate(TRACE)], "step long, action string, args string")
    states = V.traces(n.join(F.broadcast(actions)).select(F.lit("one").alias("session"), "step", "n", "action", "args"))
    return rounded(states.select(F.col("step").cast("int").alias("step"), "action", "visible", "offset", "auto", "y_min", "y_max", "tf"))


@query(f"""WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, value, date_trunc('minute', ts) AS time FROM events),
m AS (SELECT *, CASE WHEN lag(time) OVER (ORDER BY seq) = time THEN 0 ELSE 1 END AS brk FROM e), g AS (SELECT *, sum(brk) OVER (ORDER BY seq) - 1 AS run FROM m)
SELECT run::BIGINT AS run, time, arg_min(value, seq) AS open, max(value) AS high, min(value) AS low, arg_max(value, seq) AS close, arg_max(value, seq) AS volume FROM g GROUP BY 1, 2""")
def merge_delta_fold(spark, d):
    """Each event as a live row of its minute."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.lit("all").alias("series"), "ts", "event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"), *(F.col("value").alias(c) for c in OHLCV[1:]))
    return merge_deltas(rows, ["ts", "event_id"], F.date_trunc("hour", "ts")).select("run", *OHLCV)


@query(f"""WITH e AS (SELECT ts, event_id, value, CASE WHEN event_id % 97 <> 0 THEN value END AS low, date_trunc('minute', ts) AS time FROM events),
m AS (SELECT *, CASE WHEN lag(time) OVER (ORDER BY ts, event_id) = time THEN 0 ELSE 1 END AS brk FROM e), g AS (SELECT *, sum(brk) OVER (ORDER BY ts, event_id) - 1 AS run FROM m)
SELECT run::BIGINT AS run, time, CASE WHEN count(low) = count(*) THEN min(low) END AS low, min(low) AS low_corrected FROM g GROUP BY 1, 2""")
def merge_delta_without_low(spark, d):
    """Live rows some of which have no low."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.lit("all").alias("series"), "ts", "event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"), *(F.col("value").alias(c) for c in ("open", "high", "close", "volume")), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("low"))
    order, cell = ["ts", "event_id"], F.date_trunc("hour", "ts")
    right = merge_deltas(rows, order, cell, "corrected").select("series", "run", F.col("low").alias("low_corrected"))
    return merge_deltas(rows, order, cell).join(right, ["series", "run"]).select("run", "time", "low", "low_corrected")


def streamed(rows: DataFrame, stream, by: str, parts: int = 3, last: DataFrame | None = None) -> DataFrame:
    """What a stream writes that reads the rows in `parts` files or sets of files, in order of the column `by`, and then those of `last`. It is started anew from its
    checkpoint for each."""
    spark = rows.sparkSession
    given, out, checkpoint = (passing_folder(spark) for _ in range(3))
    cuts = rows.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)], 1000)).first()[0] if parts > 1 else []  # parts - 1 values
    place = sum(((F.col(by) > F.lit(c)).cast("int") for c in cuts or []), F.lit(0))
    slices = [rows.where(place == k) for k in range(parts)]
    for one in [*slices, *([] if last is None else [last])]:
        one.write.mode("append").parquet(given)
        source = spark.readStream.schema(rows.schema).parquet(given)
        sink = stream(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"""WITH e AS (SELECT ts, event_id, value, CASE WHEN event_id % 97 <> 0 THEN value END AS low, CASE WHEN event_id % 50 = 0 THEN date_trunc('minute', ts) - INTERVAL 2 MINUTES ELSE date_trunc('minute', ts) END AS time FROM events),
m AS (SELECT *, lag(time) OVER (ORDER BY ts, event_id) AS before FROM e), g AS (SELECT *, sum(CASE WHEN before = time THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id) - 1 AS run FROM m)
SELECT run::BIGINT AS run, time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, CASE WHEN count(low) = count(*) THEN min(low) END AS low, arg_max(value, (ts, event_id)) AS close,
arg_max(value, (ts, event_id)) AS volume, count(*) AS merged, coalesce(arg_min(coalesce(time < before, false), (ts, event_id)), false) AS late FROM g GROUP BY run, time""", "live_upserts")
def _live_upserts(spark, d):
    """Events as live rows of their minutes, some of them late and some without a low, through a stream that is started again three times."""
    e = spark.read.parquet(f"{d}/events.parquet")
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    time = F.when(F.col("event_id") % 50 == 0, minute - F.expr("INTERVAL 2 MINUTES")).otherwise(minute)
    low = F.when(F.col("event_id") % 97 != 0, F.col("value"))
    rows = e.select(F.lit("all").alias("series"), time.alias("time"), *((low if c == "low" else F.col("value")).alias(c) for c in OHLCV[1:]), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id")
    bars = latest_bars(streamed(rows, lambda s: live_upserts(s, ["at_us", "event_id"]), "at_us"))
    return bars.select("run", F.col("time").cast("timestamp_ntz").alias("time"), *OHLCV[1:], "merged", "late")


@query(f"{WITH_ATR} SELECT x.time, CASE WHEN x.idx >= 13 THEN round(atr, 6) END AS atr FROM x LEFT JOIN a ON a.idx = x.idx")
def live_atr14(spark, d):
    """ATR of bars that arrive in a stream; what the first bars can't know yet stays null."""
    bars = event_bars(spark, d).select("series", F.col("time").cast("timestamp").alias("time"), "high", "low", "close")
    return rounded(streamed(bars, live_atr, "time", 2).select(F.col("time").cast("timestamp_ntz").alias("time"), "atr"))


@query("WITH " + ", ".join(f"b{m} AS ({_bars(m)})" for m in (1, 5, 15)) + " " + " UNION ALL ".join(f"SELECT '{m}m' AS tf, time, open, high, low, close, volume FROM b{m}" for m in (1, 5, 15)), "live_timeframes")
def _live_timeframes(spark, d):
    """Closed bars of every timeframe from one stream; a tick of another series, a day after the last, closes the windows."""
    e = spark.read.parquet(f"{d}/events.parquet")
    ticks = e.select(F.lit("all").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"))
    closing = ticks.agg(F.max("ts").alias("ts")).select(F.lit("closing").alias("series"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(0).cast("long").alias("tick_id"), F.lit(0.0).alias("price"))
    bars = streamed(ticks, live_timeframes, "ts", 2, closing).where("series = 'all'")
    return bars.select("tf", F.col("time").cast("timestamp_ntz").alias("time"), *OHLCV[1:])


def event_csv(spark: SparkSession, d: str) -> str:
    """The events as CSV files in order of (ts, event_id)."""
    rows = spark.read.parquet(f"{d}/events.parquet").orderBy("ts", "event_id")
    out = passing_folder(spark)
    rows.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), *(F.col("value").alias(c) for c in OHLCV[1:5]), F.lit("1.5x").alias("volume")).write.mode("overwrite").option("header", True).csv(out)
    return out


_CSV = "e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS tx, date_trunc('second', ts) AS ts FROM events)"


@query(f"WITH {_CSV} SELECT seq AS idx, tx AS time, ts, value AS open, value AS high, value AS low, value AS close, 1.5::DOUBLE AS volume FROM e")
def csv_bars(spark, d):
    """Texts of a CSV file as numbers, in the order of its lines."""
    return typed_bars(read_csv(spark, event_csv(spark, d))).select("idx", "time", "ts", *OHLCV[1:])


@query(f"""WITH {_CSV}, k AS (SELECT *, left(tx, 14) || printf('%02d', (substr(tx, 15, 2)::INT // 15) * 15) || substr(tx, 17) AS key FROM e),
m AS (SELECT *, CASE WHEN lag(key) OVER (ORDER BY seq) = key THEN 0 ELSE 1 END AS brk FROM k), g AS (SELECT *, sum(brk) OVER (ORDER BY seq) - 1 AS run FROM m)
SELECT run::BIGINT AS run, key AS time, arg_min(value, seq) AS open, max(value) AS high, min(value) AS low, arg_max(value, seq) AS close, count(*) * 1.5::DOUBLE AS volume FROM g GROUP BY 1, 2""")
def csv_runs_15m(spark, d):
    return resample_runs(typed_bars(read_csv(spark, event_csv(spark, d))), "15m").select("run", *OHLCV)


def messy_csv(spark: SparkSession, d: str) -> str:
    """The events as CSV files of minutes, some out of order, some cut short after the open, and some followed by a blank line."""
    e = spark.read.parquet(f"{d}/events.parquet")
    blank = F.explode(F.when(F.col("event_id") % 97 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("blank")
    rows = e.select("*", F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("INTERVAL 3 MINUTES")).otherwise(F.col("ts")).alias("at"), blank).orderBy("at", "event_id", "blank")
    shown = lambda c: F.when(~F.col("blank"), c)
    text, value = F.date_format("ts", "yyyy-MM-dd HH:mm:00"), F.when(F.col("event_id") % 101 != 0, F.col("value"))
    out = passing_folder(spark)
    rows.select(shown(text).alias("time"), shown(F.col("value")).alias("open"), *(shown(value).alias(c) for c in OHLCV[2:5]), shown(F.when(F.col("event_id") % 101 != 0, F.lit("1.5x"))).alias("volume")).write.option("header", True).csv(out)
    return out


_MESSY = """e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 3 MINUTES ELSE ts END AS due, strftime(ts, '%Y-%m-%d %H:%M:00') AS tx, CASE WHEN event_id % 101 <> 0 THEN value ELSE 0 END AS v, CASE WHEN event_id % 101 <> 0 THEN 1.5::DOUBLE ELSE 0 END AS vol FROM events),
m AS (SELECT row_number() OVER (ORDER BY due, event_id, blank) - 1 AS seq, time, open, high, low, close, volume FROM (
SELECT due, event_id, false AS blank, tx AS time, value AS open, v AS high, v AS low, v AS close, vol AS volume FROM e UNION ALL SELECT due, event_id, true, NULL, 0, 0, 0, 0, 0 FROM e WHERE event_id % 97 = 0))"""


def _runs_sql(minutes: int) -> str:
    return f"""SELECT '{minutes}m' AS tf, run::BIGINT AS idx, key AS time, arg_min(open, seq) AS open, max(high) AS high, min(low) AS low, arg_max(close, seq) AS close, sum(volume) AS volume FROM (
SELECT *, sum(brk) OVER (ORDER BY seq) - 1 AS run FROM (SELECT *, CASE WHEN lag(key) OVER (ORDER BY seq) = key THEN 0 ELSE 1 END AS brk FROM (
SELECT *, left(time, 14) || printf('%02d', (substr(time, 15, 2)::INT // {minutes}) * {minutes}) || substr(time, 17) AS key FROM m WHERE time IS NOT NULL))) GROUP BY run, key"""


@query(f"WITH {_MESSY} SELECT '1m' AS tf, seq AS idx, time, open, high, low, close, volume FROM m UNION ALL {_runs_sql(5)} UNION ALL {_runs_sql(15)}")
def csv_timeframes(spark, d):
    """From CSV files to the bars of every timeframe."""
    return build_timeframes(load(spark, messy_csv(spark, d)).bars).drop("series")


@query(f"WITH RECURSIVE {_MESSY}, x AS (SELECT *, seq AS idx, lag(close) OVER (ORDER BY seq) AS pc FROM m), t AS (SELECT *, {FRESH} AS tr FROM x), {ATR} SELECT x.idx, x.time, round(atr, 6) AS atr FROM x LEFT JOIN a ON a.idx = x.idx")
def csv_atr14(spark, d):
    """From CSV files to the ATR of their bars."""
    return rounded(wilder_atr(load(spark, messy_csv(spark, d)).bars).select("idx", "time", "atr"))


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS loaded, count(*) FILTER (event_id % 3 = 0) AS set_aside, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 = 0) AS without_time FROM events")
def ingest_report(spark, d):
    """What a load counts: bars, rows that lack a key, bars whose time can't be read."""
    e = spark.read.parquet(f"{d}/events.parquet")
    value, time = F.col("value").cast("string"), F.when(F.col("event_id") % 7 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    whole = F.create_map(*(x for c in OHLCV for x in (F.lit(c), time if c == "time" else value)))
    return ingest(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, whole).otherwise(F.create_map(F.lit("time"), time)).alias("fields"))).report()


_REQUEST = "CASE event_id % 5 WHEN 0 THEN '1m' WHEN 1 THEN '5m' WHEN 2 THEN '15m' WHEN 3 THEN '7m' END"


@query(f"SELECT event_id, tf, coalesce(last_value(CASE WHEN tf <> '7m' THEN tf END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), '1m') AS active, coalesce(tf = '7m', true) AS refused FROM (SELECT event_id, user_id, {_REQUEST} AS tf FROM events)", "followed_timeframes")
def _followed_timeframes(spark, d):
    """Each user's requests for timeframes, known or not, and the timeframe after each."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return followed_timeframes(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.expr(_REQUEST).alias("tf"))).select(F.col("step").alias("event_id"), "tf", "active", "refused")


@query(f"SELECT '5m' AS tf, * FROM ({_bars(5)}) WHERE time::DATE BETWEEN (SELECT min(ts)::DATE + 1 FROM events) AND (SELECT min(ts)::DATE + 3 FROM events)")
def stored_bars(spark, d):
    """Bars written by series, timeframe and day, and read again for a timeframe and three days."""
    out = passing_folder(spark)
    write_bars(build_timeframes(event_bars(spark, d)), out)
    first = spark.read.parquet(out).agg(F.min("day").alias("day")).select(*(F.date_add("day", k).cast("string") for k in (1, 3))).first()
    return read_bars(spark, out, "5m", *first).select("tf", *OHLCV)


@query("WITH " + ", ".join(f"b{m} AS ({_bars(m)})" for m in (1, 5, 15)) + " " + " UNION ALL ".join(f"SELECT '{m}m' AS tf, row_number() OVER (ORDER BY time) - 1 AS idx, time, open, high, low, close, volume FROM b{m}" for m in (1, 5, 15)))
def timeframes(spark, d):
    return build_timeframes(event_bars(spark, d)).drop("series")


@query(f"WITH b AS ({_bars(15)}) SELECT row_number() OVER (ORDER BY time) - 1 AS idx, time, close FROM b")
def active_timeframe(spark, d):
    return active(build_timeframes(event_bars(spark, d)), "15m").select("idx", "time", "close")


@query("SELECT event_id AS seq, value AS close FROM events WHERE event_id % 3 <> 0")
def complete_bars(spark, d):
    """Rows that lack a key are set aside; those with an empty value pass."""
    e = spark.read.parquet(f"{d}/events.parquet")
    value = F.col("value").cast("string")
    whole = F.create_map(*(x for c in OHLCV for x in (F.lit(c), F.lit(None).cast("string") if c == "volume" else value)))
    rows = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, whole).otherwise(F.create_map(F.lit("time"), value)).alias("fields"))
    return complete(rows)[0].select("seq", number(F.col("close")).alias("close"))


@query("""SELECT event_id, CASE WHEN value >= 250 THEN floor((value - 250) / 10 + 0.5) ELSE ceil((value - 250) / 10 - 0.5) END::BIGINT AS rounded FROM events""")
def rounded_half_away(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", round_half_away((F.col("value") - 250) / 10).cast("long").alias("rounded"))


# --- extensions

_SWING = """sw0 AS (SELECT idx, high, low, count(*) OVER b4 AS nb, count(*) OVER af AS na, max(high) OVER b4 AS hb, max(high) OVER af AS ha, min(low) OVER b4 AS lb, min(low) OVER af AS la FROM x
WINDOW b4 AS (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), af AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
sw AS (SELECT idx, 'HIGH' AS type, high AS price, idx + 3 AS confirmed FROM sw0 WHERE nb = 3 AND na = 3 AND high > hb AND high > ha
UNION ALL SELECT idx, 'LOW', low, idx + 3 FROM sw0 WHERE nb = 3 AND na = 3 AND low < lb AND low < la)"""
_GAP = """f0 AS (SELECT idx, high, low, lag(high, 2) OVER (ORDER BY idx) AS h2, lag(low, 2) OVER (ORDER BY idx) AS l2 FROM x),
fv AS (SELECT idx, CASE WHEN low > h2 THEN 'BULLISH' ELSE 'BEARISH' END AS type, CASE WHEN low > h2 THEN h2 ELSE high END AS bottom, CASE WHEN low > h2 THEN low ELSE l2 END AS top FROM f0 WHERE low > h2 OR high < l2)"""
_BREAK = """st0 AS (SELECT confirmed AS idx, max(CASE WHEN type = 'HIGH' THEN price END) AS h, max(CASE WHEN type = 'LOW' THEN price END) AS l FROM sw GROUP BY 1),
st1 AS (SELECT x.idx, close, lag(close) OVER (ORDER BY x.idx) AS pc0, last_value(h IGNORE NULLS) OVER (ORDER BY x.idx) AS lh, last_value(l IGNORE NULLS) OVER (ORDER BY x.idx) AS ll FROM x LEFT JOIN st0 ON st0.idx = x.idx),
st2 AS (SELECT *, CASE WHEN close > lh AND pc0 <= lh THEN 1 WHEN close < ll AND pc0 >= ll THEN -1 END AS side FROM st1),
st AS (SELECT idx, side, lag(side) OVER (ORDER BY idx) AS prev, CASE side WHEN 1 THEN lh ELSE ll END AS price FROM st2 WHERE side IS NOT NULL),
br AS (SELECT idx, CASE WHEN prev IS NULL OR prev = side THEN 'BOS' ELSE 'CHOCH' END AS type, side, price FROM st)"""


@query(f"WITH {BASE}, {_SWING} SELECT * FROM sw")
def swing_points(spark, d):
    return X.swing_points(bars_1m(spark, d)).drop("series")


@query(f"WITH {BASE}, {_GAP} SELECT * FROM fv")
def fvg(spark, d):
    return X.fair_value_gaps(bars_1m(spark, d)).drop("series")


@query(f"WITH {BASE}, {_SWING}, {_BREAK} SELECT * FROM br")
def structure_breaks(spark, d):
    return X.structure_breaks(bars_1m(spark, d)).drop("series")


_TP = "((high + low + close) / 3)"


@query(f"WITH {BASE} SELECT idx, round(sum({_TP} * volume) OVER w / sum(volume) OVER w, 6) AS vwap FROM x WINDOW w AS (PARTITION BY time::DATE ORDER BY idx)")
def vwap_session(spark, d):
    return rounded(X.session_vwap(with_day(bars_1m(spark, d))).drop("series"))


@query(f"""WITH {BASE}, {_SWING}, {_BREAK}, m AS (SELECT x.*, count(br.idx) OVER (ORDER BY x.idx) AS anchor_id FROM x LEFT JOIN br ON br.idx = x.idx)
SELECT idx, anchor_id, CASE WHEN anchor_id > 0 THEN round(sum({_TP} * volume) OVER w / sum(volume) OVER w, 6) END AS vwap FROM m WINDOW w AS (PARTITION BY anchor_id ORDER BY idx)""")
def vwap_anchored(spark, d):
    bars = bars_1m(spark, d)
    return rounded(X.anchored_vwap(bars, X.structure_breaks(bars)).drop("series"))


_PROFILE = f"vp AS (SELECT strftime(time, '%Y-%m-%d') AS day, floor({_TP} / 10)::BIGINT AS bin, sum(volume) AS volume FROM x GROUP BY 1, 2)"


@query(f"WITH {BASE}, {_PROFILE} SELECT * FROM vp")
def volume_profile(spark, d):
    return X.volume_profile(with_day(bars_1m(spark, d))).drop("series").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {BASE}, {_PROFILE}, v1 AS (SELECT *, coalesce(sum(volume) OVER (PARTITION BY day ORDER BY volume DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
sum(volume) OVER (PARTITION BY day) AS total, row_number() OVER (PARTITION BY day ORDER BY volume DESC, bin) AS nth FROM vp)
SELECT day, max(CASE WHEN nth = 1 THEN bin END) AS poc, min(bin) AS val, max(bin) AS vah, max(total) AS volume FROM v1 WHERE bef < 0.7::DOUBLE * total GROUP BY 1""")
def poc_value_area(spark, d):
    return X.value_area(X.volume_profile(with_day(bars_1m(spark, d)))).drop("series").withColumn("day", F.col("day").cast("string"))


_SEGMENTS = {
    "SESSION": ("sg AS (SELECT *, time::DATE - DATE '1970-01-01' AS segment FROM x)", ""),
    "STRUCTURE": ("sg AS (SELECT x.*, count(br.idx) OVER (ORDER BY x.idx) AS segment FROM x LEFT JOIN br ON br.idx = x.idx)", f"{_SWING}, {_BREAK}, "),
    "HISTORICAL": ("sg AS (SELECT *, 0 AS segment FROM x)", ""),
}
_SPREAD = """sp AS (SELECT *, unnest(generate_series(floor(low / 10)::BIGINT, floor(high / 10)::BIGINT)) AS bin FROM sg),
pf AS (SELECT segment, bin, round(sum(CASE WHEN high > low THEN (least(high, (bin + 1) * 10::DOUBLE) - greatest(low, bin * 10::DOUBLE)) / (high - low) ELSE 1 END * volume), 9) AS volume FROM sp
WHERE high = low OR least(high, (bin + 1) * 10::DOUBLE) - greatest(low, bin * 10::DOUBLE) > 0 GROUP BY 1, 2)"""
_AREA = """gl AS (SELECT segment, list(bin ORDER BY bin) AS b, list(volume ORDER BY bin) AS v, sum(volume) AS total, count(*) AS n FROM pf GROUP BY 1),
gr AS (SELECT segment, list_position(v, list_max(v)) AS lo, list_position(v, list_max(v)) AS hi, list_max(v) AS acc FROM gl
UNION ALL SELECT segment, CASE WHEN up >= dn THEN lo ELSE lo - 1 END, CASE WHEN up >= dn THEN hi + 1 ELSE hi END, acc + greatest(up, dn) FROM (
SELECT gr.*, CASE WHEN hi < n THEN v[hi + 1] ELSE -1 END AS up, CASE WHEN lo > 1 THEN v[lo - 1] ELSE -1 END AS dn FROM gr JOIN gl ON gl.segment = gr.segment WHERE round(acc, 6) < round(0.7::DOUBLE * total, 6) AND (lo > 1 OR hi < n)))
SELECT gl.segment::BIGINT AS segment, b[list_position(v, list_max(v))] AS poc, b[lo] AS val, b[hi] AS vah, round(acc, 6) AS inside, round(total, 6) AS volume FROM gl JOIN (SELECT segment, min(lo) AS lo, max(hi) AS hi, max(acc) AS acc FROM gr GROUP BY 1) r ON r.segment = gl.segment"""


def _profiles(mode: str) -> None:
    cte, before = _SEGMENTS[mode]

    def profile(spark, d):
        return X.spread_profile(X.segments(bars_1m(spark, d), mode))

    name = mode.lower()
    query(f"WITH {BASE}, {before}{cte}, {_SPREAD} SELECT segment::BIGINT AS segment, bin, round(volume, 6) AS volume FROM pf", f"profile_{name}")(lambda spark, d: rounded(profile(spark, d).drop("series")))
    query(f"WITH RECURSIVE {BASE}, {before}{cte}, {_SPREAD}, {_AREA}", f"value_area_{name}")(lambda spark, d: rounded(X.grown_area(profile(spark, d)).drop("series")))


for _mode in X.PROFILES:
    _profiles(_mode)


_LIQUIDITY = """xs AS (SELECT 'BUY' AS side, idx, high AS v, close AS e FROM x UNION ALL SELECT 'SELL', idx, -low, -close FROM x),
hl AS (SELECT CASE type WHEN 'HIGH' THEN 'BUY' ELSE 'SELL' END AS side, idx AS level_idx, CASE type WHEN 'HIGH' THEN price ELSE -price END AS p, confirmed FROM sw),
s1 AS (SELECT hl.side, level_idx, min(xs.idx) AS swept_idx FROM hl JOIN xs ON xs.side = hl.side AND xs.idx > confirmed AND xs.v > p GROUP BY 1, 2),
s2 AS (SELECT hl.side, hl.level_idx, min((e > p)::INT) AS held, arg_min((e > p)::INT, xs.idx) AS one, count(*) AS k, min(CASE WHEN NOT e > p THEN xs.idx END) AS back, max(xs.idx) AS last FROM s1 JOIN hl ON hl.side = s1.side AND hl.level_idx = s1.level_idx JOIN xs ON xs.side = hl.side AND xs.idx BETWEEN swept_idx AND swept_idx + 2 GROUP BY 1, 2),
s3 AS (SELECT hl.*, swept_idx, held = 1 AS held, one, k, back, last FROM hl LEFT JOIN s1 ON s1.side = hl.side AND s1.level_idx = hl.level_idx LEFT JOIN s2 ON s2.side = hl.side AND s2.level_idx = hl.level_idx),
s4 AS (SELECT *, CASE WHEN one = 0 THEN 'GRAB' WHEN NOT held THEN 'SWEEP' WHEN k = 3 THEN 'RUN' END AS kind FROM s3),
lq AS (SELECT side, level_idx, abs(p) AS price, swept_idx, CASE WHEN swept_idx IS NULL THEN 'DETECTED' WHEN kind = 'RUN' THEN 'ACCEPTANCE' WHEN NOT held THEN 'RECLAIMED' ELSE 'SWEPT' END AS state, kind, kind IS NOT NULL AS resolved, CASE WHEN kind = 'RUN' THEN last ELSE back END AS resolved_idx FROM s4),
ev AS (SELECT resolved_idx, arg_max({'side': side, 'kind': kind, 'swept': swept_idx}, (level_idx, side = 'BUY')) AS e FROM lq WHERE resolved GROUP BY 1)"""


@query(f"WITH {BASE}, {_SWING}, {_LIQUIDITY} SELECT * FROM lq")
def liquidity_states(spark, d):
    return X.liquidity_states(bars_1m(spark, d)).drop("series")


_NEAR = "coalesce(e.kind IN ('SWEEP', 'GRAB') AND {}.idx - resolved_idx <= 20, false)"


@query(f"""WITH {BASE}, {_SWING}, {_BREAK}, {_LIQUIDITY} SELECT br.idx, type, side, price, e.swept AS sweep_idx, e.kind AS sweep_kind,
CASE WHEN {_NEAR.format('br')} AND e.side = CASE side WHEN 1 THEN 'SELL' ELSE 'BUY' END THEN 3 WHEN {_NEAR.format('br')} THEN 2 ELSE 1 END::DOUBLE AS weight FROM br ASOF LEFT JOIN ev ON br.idx >= resolved_idx""")
def weighted_breaks(spark, d):
    """Breaks of structure, weighed by the liquidity event that was resolved last."""
    return X.weighted_breaks(bars_1m(spark, d)).drop("series")


_EQUAL = "pr AS (SELECT CASE s.type WHEN 'HIGH' THEN 'EQH' ELSE 'EQL' END AS type, s.idx, e.idx AS earlier_idx, s.price, e.price AS earlier_price FROM sw s JOIN sw e ON s.type = e.type AND e.idx < s.idx AND s.idx - e.idx <= 500 JOIN a ON a.idx = s.idx WHERE abs(s.price - e.price) <= 0.10::DOUBLE * atr)"


@query(f"{WITH_ATR}, {_SWING}, {_EQUAL} SELECT * FROM pr")
def equal_swings(spark, d):
    """Pairs of swing highs or lows within a tenth of the ATR of each other."""
    return X.equal_swings(wilder_atr(bars_1m(spark, d))).drop("series")


@query(f"""{WITH_ATR}, {_SWING}, {_EQUAL}, up AS (SELECT type, idx, max(earlier_idx) AS before, arg_max(earlier_price, earlier_idx) AS before_price, max(price) AS price FROM pr GROUP BY 1, 2),
rt AS (SELECT DISTINCT u.type, u.before AS idx, u.before_price AS price FROM up u ANTI JOIN up ON up.type = u.type AND up.idx = u.before),
fl AS (SELECT type, idx, price, idx AS level_idx FROM rt UNION ALL SELECT up.type, up.idx, up.price, fl.level_idx FROM fl JOIN up ON up.type = fl.type AND up.before = fl.idx)
SELECT type, level_idx, count(*) AS n, min(price) AS low, max(price) AS high, max(idx) AS last_idx FROM fl GROUP BY 1, 2""")
def equal_levels(spark, d):
    """Equal highs and lows as levels, each with the swings that follow its first one."""
    return X.equal_levels(X.equal_swings(wilder_atr(bars_1m(spark, d)))).drop("series")


@query(f"WITH {BASE}, {_SWING}, {_BREAK} SELECT arg_min(idx, idx) AS idx, 'SESSION' AS type, arg_min(open, idx) AS price FROM x GROUP BY time::DATE UNION ALL SELECT idx, type, price FROM br")
def anchor_events(spark, d):
    return X.anchor_events(bars_1m(spark, d)).drop("series")


@query(f"WITH {BASE}, {_SWING}, {_BREAK}, ty AS (SELECT idx, type FROM br UNION ALL SELECT idx, type FROM sw UNION ALL SELECT min(idx), 'SESSION' FROM x GROUP BY time::DATE) SELECT idx, type, type IN ('SESSION', 'BOS', 'CHOCH', 'POC') AS known FROM ty")
def anchor_whitelist(spark, d):
    """Which of the events of a series a VWAP may be anchored to."""
    bars = bars_1m(spark, d)
    events = X.anchor_events(bars).select("idx", "type").unionByName(X.swing_points(bars).select("idx", "type"))
    return events.select("idx", "type", F.col("type").isin(ANCHOR_TYPES).alias("known"))


@query(f"WITH {BASE}, {COUNT}, {_GAP} SELECT idx, CASE type WHEN 'BULLISH' THEN 'DEMAND' ELSE 'SUPPLY' END AS zone, bottom, top, round(greatest(0.0, 1 - 0.05::DOUBLE * (n - 1 - idx)), 6) AS alpha FROM fv, n")
def zones(spark, d):
    return rounded(X.zones(bars_1m(spark, d)).drop("series"))


@query(f"""WITH {BASE}, {COUNT}, {_SWING}, {_GAP}, {_LIQUIDITY}, z AS (SELECT idx, CASE type WHEN 'BULLISH' THEN 'DEMAND' ELSE 'SUPPLY' END AS zone, bottom, top, greatest(0.0, 1 - 0.05::DOUBLE * (n - 1 - idx)) AS alpha FROM fv, n),
mt AS (SELECT z.idx, min(x.idx) FILTER (x.low <= top AND x.high >= bottom) AS mitigated_idx, min(x.idx) FILTER (CASE zone WHEN 'DEMAND' THEN x.low <= bottom ELSE x.high >= top END) AS filled_idx, min(x.low) AS lo, max(x.high) AS hi FROM z LEFT JOIN x ON x.idx > z.idx GROUP BY z.idx)
SELECT z.idx, zone, bottom, top, round(alpha, 6) AS alpha, mitigated_idx, filled_idx, CASE WHEN filled_idx IS NULL THEN CASE zone WHEN 'DEMAND' THEN bottom ELSE greatest(bottom, coalesce(hi, bottom)) END END AS bottom_left,
CASE WHEN filled_idx IS NULL THEN CASE zone WHEN 'DEMAND' THEN least(top, coalesce(lo, top)) ELSE top END END AS top_left, {_NEAR.format('z')} AS reaction FROM z JOIN mt ON mt.idx = z.idx ASOF LEFT JOIN ev ON z.idx >= resolved_idx""")
def mitigated_zones(spark, d):
    """Zones with the bars that meet and fill them, what is left of them, and whether liquidity was rejected just before."""
    return rounded(X.mitigated_zones(bars_1m(spark, d)).drop("series"))


@query(f"WITH {BASE}, {_SWING}, {_GAP}, {_BREAK} SELECT br.idx, CASE side WHEN 1 THEN 'BUY' ELSE 'SELL' END AS signal, br.type AS reason FROM br JOIN fv ON fv.idx = br.idx AND (fv.type = 'BULLISH') = (side = 1)")
def signals(spark, d):
    return X.signals(bars_1m(spark, d)).drop("series")


_SIDE = "CASE side WHEN 'BUY' THEN '#2962ff' ELSE '#ff6d00' END"
_AT = lambda c: _X.replace("(idx", f"({c}")


@query(f"""WITH RECURSIVE {BASE}, {COUNT}, {_W}, {_P}, {_SWING}, {_GAP}, {_BREAK}, {_LIQUIDITY}, z AS (SELECT idx, CASE type WHEN 'BULLISH' THEN 'DEMAND' ELSE 'SUPPLY' END AS zone, bottom, top, greatest(0.0, 1 - 0.05::DOUBLE * (n - 1 - idx)) AS alpha FROM fv, n),
mt AS (SELECT z.idx, any_value(zone) AS zone, any_value(bottom) AS bottom, any_value(top) AS top, any_value(alpha) AS alpha, min(x.idx) FILTER (x.low <= top AND x.high >= bottom) AS met FROM z LEFT JOIN x ON x.idx > z.idx GROUP BY z.idx),
vw AS (SELECT idx, sum({_TP} * volume) OVER o / sum(volume) OVER o AS vwap FROM x WINDOW o AS (PARTITION BY time::DATE ORDER BY idx)),
vl AS (SELECT lag({_X}) OVER (ORDER BY idx) AS x1, lag({_Y.format('vwap')}) OVER (ORDER BY idx) AS y1, {_X} AS x2, {_Y.format('vwap')} AS y2 FROM vw, p, n WHERE idx BETWEEN n - 100 AND n - 1),
si AS (SELECT x.idx, side, high, low FROM br JOIN fv ON fv.idx = br.idx AND (fv.type = 'BULLISH') = (side = 1) JOIN x ON x.idx = br.idx),
sg AS (SELECT *, 0 AS segment FROM w), {_SPREAD}, ar AS (WITH RECURSIVE {_AREA}),
u AS (SELECT CASE side WHEN 'BUY' THEN 'bsl' ELSE 'ssl' END AS kind, {_AT('greatest(level_idx, n - 100)')} AS x1, {_Y.format('price')} AS y1, {_AT('least(coalesce(swept_idx, n - 1), n - 1)')} AS x2, {_Y.format('price')} AS y2, {_SIDE} AS color, NULL::VARCHAR AS text FROM lq, p, n WHERE coalesce(swept_idx, n - 1) >= n - 100
UNION ALL SELECT 'sweep', {_AT('swept_idx')}, {_Y.format('price')}, NULL, NULL, {_SIDE}, kind FROM lq, p, n WHERE kind IS NOT NULL AND swept_idx >= n - 100
UNION ALL SELECT 'zone', {_AT('greatest(idx, n - 100)')}, {_Y.format('top')}, {_AT('least(coalesce(met, n - 1), n - 1)')}, {_Y.format('bottom')}, CASE zone WHEN 'DEMAND' THEN '#1b5e20' ELSE '#7f0000' END, printf('%.2f', alpha) FROM mt, p, n WHERE coalesce(met, n - 1) >= n - 100
UNION ALL SELECT 'vwap', x1, y1, x2, y2, '#aa00ff', NULL FROM vl WHERE x1 IS NOT NULL
UNION ALL SELECT 'signal', {_X}, CASE side WHEN 1 THEN {_Y.format('low')} ELSE {_Y.format('high')} END, NULL, NULL, CASE side WHEN 1 THEN '#26a69a' ELSE '#ef5350' END, CASE side WHEN 1 THEN 'BUY' ELSE 'SELL' END FROM si, p, n WHERE idx >= n - 100
UNION ALL SELECT 'profile', 800 - 200 * volume / (SELECT max(volume) FROM pf), {_Y.format('(bin + 1) * 10')}, 800, {_Y.format('bin * 10')}, '#455a64', NULL FROM pf, p
UNION ALL SELECT k, 0, {_Y.format('v * 10')}, 800, {_Y.format('v * 10')}, '#455a64', NULL FROM (SELECT 'poc' AS k, poc + 0.5 AS v FROM ar UNION ALL SELECT 'val', val FROM ar UNION ALL SELECT 'vah', vah + 1 FROM ar), p)
SELECT 'price' AS panel, kind, round(x1::DOUBLE, 4) AS x1, round(y1::DOUBLE, 4) AS y1, round(x2::DOUBLE, 4) AS x2, round(y2::DOUBLE, 4) AS y2, color, text FROM u""")
def overlay_marks(spark, d):
    """Levels, sweeps, zones, VWAP, profile and signals of the default view as marks."""
    bars = settled(bars_1m(spark, d))  # read for each overlay
    drawn = [O.Liquidity(X.liquidity_states(bars)), O.Zones(X.mitigated_zones(bars)), O.Vwap(X.session_vwap(with_day(bars))), O.Signals(X.signals(bars), bars), O.Profile(bars)]
    return rounded(O.overlay_marks(bars, drawn), 4)


_FOLD = f"{WITH_ATR}, d AS (SELECT x.idx, high, low, close, atr, lag(high) OVER w AS h0, lag(low) OVER w AS l0, x.pc FROM x JOIN a ON a.idx = x.idx WINDOW w AS (ORDER BY x.idx))"


@query(f"""{_FOLD}, u AS (SELECT *, (high + low) / 2 + 3 * atr AS u, (high + low) / 2 - 3 * atr AS d FROM d),
z AS (SELECT idx, u AS up, d AS down, CASE WHEN close < d THEN -1 ELSE 1 END AS side FROM u WHERE idx = 0
UNION ALL SELECT idx, up, down, CASE WHEN side < 0 AND close > up THEN 1 WHEN side > 0 AND close < down THEN -1 ELSE side END FROM (
SELECT u.idx, u.close, z.side, CASE WHEN u.u < z.up OR u.pc > z.up THEN u.u ELSE z.up END AS up, CASE WHEN u.d > z.down OR u.pc < z.down THEN u.d ELSE z.down END AS down FROM z JOIN u ON u.idx = z.idx + 1))
SELECT idx, side::BIGINT AS trend, round(CASE WHEN side > 0 THEN down ELSE up END, 6) AS line FROM z""")
def supertrend(spark, d):
    return rounded(X.supertrend(wilder_atr(bars_1m(spark, d))).drop("series"))


@query(f"""{_FOLD}, z AS (SELECT idx, least(close, close + 1.5::DOUBLE * atr) AS v FROM d WHERE idx = 0
UNION ALL SELECT d.idx, CASE WHEN close > v THEN greatest(v, close - 1.5::DOUBLE * atr) ELSE least(v, close + 1.5::DOUBLE * atr) END FROM z JOIN d ON d.idx = z.idx + 1) SELECT idx, round(v, 6) AS line FROM z""")
def range_filter(spark, d):
    return rounded(X.range_filter(wilder_atr(bars_1m(spark, d))).drop("series"))


@query(f"""{_FOLD}, g AS (SELECT *, greatest(high, h0) AS hi, least(low, l0) AS lo, (high + h0) / 2 AS hm, (low + l0) / 2 AS lm FROM d),
z AS (SELECT idx, 1 AS side, low AS top, high AS bottom, low AS line, atr FROM g WHERE idx = 0
UNION ALL SELECT idx, now, CASE WHEN side > 0 THEN t WHEN now > 0 THEN lo ELSE top END, CASE WHEN side < 0 THEN b WHEN now < 0 THEN hi ELSE bottom END,
CASE WHEN now <> side THEN line WHEN now > 0 THEN greatest(line, t) ELSE least(line, b) END, atr FROM (
SELECT *, CASE WHEN side > 0 AND hm < t AND close < l0 THEN -1 WHEN side < 0 AND lm > b AND close > h0 THEN 1 ELSE side END AS now FROM (
SELECT g.*, z.side, z.top, z.bottom, z.line, greatest(z.top, g.lo) AS t, least(z.bottom, g.hi) AS b FROM z JOIN g ON g.idx = z.idx + 1)))
SELECT idx, side::BIGINT AS trend, round(line, 6) AS line, round(line + atr, 6) AS upper, round(line - atr, 6) AS lower FROM z""")
def halftrend(spark, d):
    return rounded(X.halftrend(wilder_atr(bars_1m(spark, d))).drop("series"))


@query(f"""WITH {BASE}, {_PROFILE}, pk AS (SELECT day, bin AS poc FROM vp QUALIFY row_number() OVER (PARTITION BY day ORDER BY volume DESC, bin) = 1)
SELECT day, poc, idx FROM x JOIN pk ON strftime(time, '%Y-%m-%d') = day AND floor({_TP} / 10) = poc QUALIFY row_number() OVER (PARTITION BY day ORDER BY volume DESC, idx) = 1""")
def poc_bars(spark, d):
    return X.poc_bars(with_day(bars_1m(spark, d))).drop("series").withColumn("day", F.col("day").cast("string"))

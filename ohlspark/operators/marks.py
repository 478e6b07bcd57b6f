"""Marks of a chart as tables; windows of a view are small, and so are these. A view's bounds and ranges are rows that are joined in, not numbers that the
driver asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohlspark.functions.scalars import clock_label, crosshair_label, date_prefix, direction, format_fixed, grid_label, nice_step, tick_quantise
from ohlspark.functions.scale import Scale, atr_scale, price_scale
from ohlspark.operators.ranges import atr_range, price_range
from ohlspark.sources.bars import settled


def view_bounds(bars: DataFrame, visible: float, offset: float) -> DataFrame:
    """One row: first_idx and end_idx, the first and last position of a view on all of the bars; the last may lie past their end."""
    n = F.col("n").cast("double")
    end = n - 1 - offset
    start = F.greatest(F.lit(0.0), end - visible + 1)
    end = F.greatest(F.lit(0.0), end)
    some = n > 0
    return bars.agg(F.count("*").alias("n")).select(F.when(some, F.least(start, end)).otherwise(0.0).alias("first_idx"), F.when(some, end).otherwise(0.0).alias("end_idx"))


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """The columns of a table of one row beside every row."""
    return df.crossJoin(F.broadcast(row))


def viewed(bars: DataFrame, visible: float, offset: float = 0) -> DataFrame:
    """The bars of a view, with its bounds; fractions of the bounds are cut off."""
    return _within(with_row(bars, view_bounds(bars, visible, offset)))


def _within(bounded: DataFrame) -> DataFrame:
    return bounded.where(F.col("idx").between(F.col("first_idx").cast("long"), F.col("end_idx").cast("long")))


def candle_marks(window: DataFrame, scale: Scale) -> DataFrame:
    """Wick and body of each bar: idx, x, y_high, y_low, x1, x2, y_top, y_bottom, direction."""
    x = scale.x_centre(F.col("idx"))
    half = max(1, 0.8 * scale.width / scale.visible) / 2
    y1, y2 = scale.y(F.col("open")), scale.y(F.col("close"))
    return window.select(
        "idx", x.alias("x"), scale.y(F.col("high")).alias("y_high"), scale.y(F.col("low")).alias("y_low"), (x - half).alias("x1"), (x + half).alias("x2"),
        F.least(y1, y2).alias("y_top"), F.greatest(y1, y2).alias("y_bottom"), direction(F.col("open"), F.col("close")).alias("direction"),
    )


def polyline(window: DataFrame, scale: Scale, value: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Segments from each defined value to the next; nulls are bridged. With the view's start and end points stand where the walk from a start that may be a
    fraction meets them: that fraction right of their bars, and none beyond the end."""
    w = Window.partitionBy("series").orderBy("idx")
    at = F.col("idx") if start is None else F.col("idx") + (start - start.cast("long"))
    points = window.where(F.col(value).isNotNull()) if end is None else window.where(F.col(value).isNotNull() & (at <= end))
    points = points.select("series", "idx", scale.x_centre(at).alias("x2"), scale.y(F.col(value)).alias("y2"))
    lines = points.select("idx", F.lag("x2").over(w).alias("x1"), F.lag("y2").over(w).alias("y1"), "x2", "y2")
    return lines.where("x1 IS NOT NULL")


def last_price_mark(window: DataFrame, scale: Scale) -> DataFrame:
    last = window.orderBy(F.desc("idx")).limit(1)
    return last.select("idx", scale.y(F.col("close")).alias("y"), format_fixed(F.col("close"), 2).alias("label"), direction(F.col("open"), F.col("close")).alias("direction"))


def last_atr_mark(values: DataFrame, scale: Scale, end: float | Column) -> DataFrame:
    """At the view's end, which may lie past the last bar: then there is none."""
    at = values.where((F.col("idx") == (end.cast("long") if isinstance(end, Column) else int(end))) & F.col("atr").isNotNull())
    return at.select("idx", scale.y(F.col("atr")).alias("y"), format_fixed(F.col("atr"), 4).alias("label"))


def grid(ends: DataFrame, height: float) -> DataFrame:
    """ends(y_min, y_max) -> n, value, label: the multiples of a nice step in the range; none if it is empty."""
    # explode keeps each expression from being copied into all that use it
    step = ends.where("y_max > y_min").select("y_min", "y_max", F.explode(F.array(nice_step(F.col("y_min"), F.col("y_max"), height))).alias("step"))
    first = (F.col("y_min") / F.col("step")).cast("long") * F.col("step")
    step = step.select("*", F.explode(F.array(F.when(first < F.col("y_min"), first + F.col("step")).otherwise(first))).alias("first"))
    count = F.floor((F.col("y_max") - F.col("first")) / F.col("step") + 1e-9)
    lines = step.where(count >= 0).select("step", "first", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("n"))
    value = F.round(F.col("first") + F.col("n") * F.col("step"), 9)
    return lines.select("n", value.alias("value"), grid_label(value, F.col("step")).alias("label"))


def day_changes(window: DataFrame, time: Column) -> DataFrame:
    """Adds day and is_day_change against the last known day of the window; the first bar is none."""
    w = Window.partitionBy("series").orderBy("idx")
    day = date_prefix(time)
    before = F.last(F.when(F.col("day") != "", F.col("day")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return window.withColumn("day", day).withColumn("is_day_change", F.coalesce(F.col("day") != before, F.lit(False)))


def label_step(visible: float) -> int:
    return 50 if visible > 500 else 10 if visible > 100 else 5 if visible > 30 else 1


def axis_labels(window: DataFrame, start: float | Column, visible: float, time: str = "time_text") -> DataFrame:
    """Days where they change, and every step-th bar that has no change of day close by: rel_index, timestamp, is_day_change, label."""
    step = label_step(visible)
    near = max(1, step // 4)
    w = Window.partitionBy("series").orderBy("idx").rowsBetween(-near, near)
    rows = day_changes(window, F.col(time)).withColumn("crowded", F.max("is_day_change").over(w))
    shown = rows.where(F.col("is_day_change") | ((F.col("idx") % step == 0) & ~F.col("crowded")))
    return shown.select((F.col("idx") - start).cast("double").alias("rel_index"), F.col(time).alias("timestamp"), "is_day_change", clock_label(F.col(time), F.col("is_day_change")).alias("label"))


def crosshair(bars: DataFrame, cursors: DataFrame, scale: Scale, time: str = "time_text") -> DataFrame:
    """cursors(cursor_id, x, y, and the columns of the scale) -> the position that each picks, its time label, null where no bar
    stands there, and the price under the cursor."""
    picks = cursors.select("cursor_id", scale.index(F.col("x")).cast("long").alias("idx"), tick_quantise(scale.value(F.col("y"))).alias("price"))
    found = bars.select("idx", F.col(time).alias("text"))
    label = F.when(F.col("text").isNotNull(), crosshair_label(F.col("text")))
    return picks.join(found, "idx", "left").select("cursor_id", "idx", label.alias("time_label"), format_fixed(F.col("price"), 2).alias("price_label"))


def active_panel(y: Column, price_height: float = 400, atr_height: float = 160) -> Column:
    """The panel under a cursor, where the ATR panel lies below the price panel; null outside."""
    return F.when((y >= 0) & (y < price_height), "price").when((y >= price_height) & (y < price_height + atr_height), "atr")


def atr_crosshair(cursors: DataFrame, scale: Scale) -> DataFrame:
    """cursors(cursor_id, x, y) over the ATR panel -> the value under each, not sent to a tick."""
    return cursors.select("cursor_id", "x", "y", format_fixed(scale.value(F.col("y")), 4).alias("atr_label"))


def hover_hits(bars: DataFrame, cursors: DataFrame, scale: Scale, slack: float = 5) -> DataFrame:
    """Cursors that lie on the bar they pick, from high to low and `slack` pixels more."""
    picks = cursors.withColumn("idx", scale.index(F.col("x")).cast("long"))
    a, b = scale.y(F.col("high")), scale.y(F.col("low"))
    return bars.select("idx", "high", "low").join(picks, "idx").where(F.col("y").between(F.least(a, b) - slack, F.greatest(a, b) + slack)).select("cursor_id", "idx")


# Fixed colours of marks.
UP, DOWN, ATR_LINE, GRID, GRID_TEXT, TIME_TEXT, DAY_TEXT = "#26a69a", "#ef5350", "#75bbfd", "#1f2933", "#787b86", "#4b4b4c", "#000000"
#: Our colours of marks that have no fixed one.
CROSS, DEMAND, SUPPLY, BUY_SIDE, SELL_SIDE, VWAP_LINE, PROFILE = "#9598a1", "#1b5e20", "#7f0000", "#2962ff", "#ff6d00", "#aa00ff", "#455a64"
#: Where the texts of the value axis and of the time axis are centred.
AXIS_X, AXIS_Y = 37.0, 12.0
MARK = ["panel", "kind", "x1", "y1", "x2", "y2", "color", "text"]


def marks_of(rows: DataFrame, panel: str, kind: str, x1: Column, y1: Column, x2: Column | None, y2: Column | None, color: Column, text: Column | None = None) -> DataFrame:
    """One kind of mark as rows of the common mark table."""
    number = lambda c: (F.lit(None) if c is None else c).cast("double")
    shown = (F.lit(None) if text is None else text).cast("string")
    return rows.select(F.lit(panel).alias("panel"), F.lit(kind).alias("kind"), number(x1).alias("x1"), number(y1).alias("y1"), number(x2).alias("x2"), number(y2).alias("y2"), color.alias("color"), shown.alias("text"))


def panel_grid(ends: DataFrame, scale: Scale, panel: str) -> DataFrame:
    """Grid lines across the plot and their labels on the value axis."""
    lines = with_row(grid(ends, scale.height), ends)
    y = scale.y(F.col("value"))
    line = marks_of(lines, panel, "grid", F.lit(0), y, F.lit(scale.width), y, F.lit(GRID))
    return line.unionByName(marks_of(lines, panel, "grid_label", F.lit(AXIS_X), y, None, None, F.lit(GRID_TEXT), F.col("label")))


def time_axis(labels: DataFrame, start: float | Column, scale: Scale) -> DataFrame:
    """axis_labels (with the columns of start and scale) -> their texts, centred on their bars."""
    x = scale.x_centre(F.col("rel_index") + start)
    return marks_of(labels, "time", "time_label", x, F.lit(AXIS_Y), None, None, F.when(F.col("is_day_change"), DAY_TEXT).otherwise(TIME_TEXT), F.col("label"))


def unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def frame(bars: DataFrame, visible: float = 100, offset: float = 0, cursors: DataFrame | None = None) -> DataFrame:
    """bars(series, idx, time_text, ..., atr) -> all marks of a view as one table (MARK): grids, wicks and bodies, the ATR line, the last price and the last ATR, the
    time axis, and for cursors(cursor_id, x, y) the crosshair of each in its panel. An empty window gives no rows. The bars are worked out once: those of the
    view and one beside it on either side, which all marks are made of, are a small table of their own."""
    near = F.col("idx").between(F.col("first_idx").cast("long") - 1, F.col("end_idx").cast("long") + 2)
    around = settled(with_row(bars, view_bounds(bars, visible, offset)).where(near))
    window = _within(around)
    atr_ends = atr_range(window).toDF("a_min", "a_max")
    row = settled(window.select("first_idx", "end_idx").limit(1).crossJoin(price_range(window)).crossJoin(atr_ends))  # of one row each
    end, low, high = F.col("end_idx"), F.col("y_min"), F.col("y_max")
    prices, atrs = price_scale(end, visible, low, high), atr_scale(end, visible, F.col("a_min"), F.col("a_max"))
    window = with_row(window.drop("first_idx", "end_idx"), row)
    candles = candle_marks(window, prices)
    color = lambda: F.when(F.col("direction") == "up", UP).otherwise(DOWN)
    labels = with_row(axis_labels(window, F.col("first_idx"), visible), row)
    last, last_atr = last_price_mark(window, prices), last_atr_mark(window, atrs, end)
    price_ends, atr_ends = row.select("y_min", "y_max"), row.select(F.col("a_min").alias("y_min"), F.col("a_max").alias("y_max"))
    parts = [
        panel_grid(price_ends, prices, "price"), panel_grid(atr_ends, atr_scale(end, visible, low, high), "atr"),
        marks_of(candles, "price", "wick", F.col("x"), F.col("y_high"), F.col("x"), F.col("y_low"), color()), marks_of(candles, "price", "body", F.col("x1"), F.col("y_top"), F.col("x2"), F.col("y_bottom"), color()),
        marks_of(polyline(window, atrs, "atr", F.col("first_idx"), end), "atr", "line", F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(ATR_LINE)), time_axis(labels, F.col("first_idx"), prices),
        marks_of(last, "price", "last", F.lit(0), F.col("y"), F.lit(prices.width), F.col("y"), color(), F.col("label")),
        marks_of(last_atr, "atr", "last", F.lit(0), F.col("y"), F.lit(atrs.width), F.col("y"), F.lit(ATR_LINE), F.col("label")),
    ]
    if cursors is not None:
        parts.append(crosshair_marks(around, cursors, row, prices, atrs))
    return unioned(parts)


def crosshair_marks(bars: DataFrame, cursors: DataFrame, row: DataFrame, prices: Scale, atrs: Scale) -> DataFrame:
    """cursors(cursor_id, x, y), y counted from the top of the price panel, below which the ATR panel lies, and the one row of the scales' columns -> lines through the
    cursor over both panels, the value under it in the panel where it is, and the time of the bar that it picks, where one stands there."""
    at = with_row(cursors.withColumn("under", active_panel(F.col("y"), prices.height, atrs.height)).where("under IS NOT NULL"), row)
    priced, valued = at.where("under = 'price'"), at.where("under = 'atr'")
    price = format_fixed(tick_quantise(prices.value(F.col("y"))), 2)
    deep = F.col("y") - prices.height
    picks = at.withColumn("idx", prices.index(F.col("x")).cast("long"))
    timed = picks.join(bars.select("idx", "time_text"), "idx")
    across = lambda rows, panel, y, text, width: marks_of(rows, panel, "cross_h", F.lit(0), y, F.lit(width), y, F.lit(CROSS), text)
    down = lambda panel, height: marks_of(at, panel, "cross_v", F.col("x"), F.lit(0), F.col("x"), F.lit(height), F.lit(CROSS))
    return unioned([
        across(priced, "price", F.col("y"), price, prices.width), across(valued, "atr", deep, format_fixed(atrs.value(deep), 4), atrs.width),
        down("price", prices.height), down("atr", atrs.height), marks_of(timed, "time", "cross_time", F.col("x"), F.lit(AXIS_Y), None, None, F.lit(CROSS), crosshair_label(F.col("time_text"))),
    ])

"""What indicators draw over the price panel, as rows of the common mark table.

Levels and zones live from a bar to another one or on; those whose life meets the view are taken and cut to it. A view is one row (first_idx, end_idx,
y_min, y_max) that is joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohlspark.functions.scalars import format_fixed
from ohlspark.functions.scale import price_scale
from ohlspark.operators import marks as M
from ohlspark.operators.extensions import grown_area, spread_profile
from ohlspark.operators.ranges import price_range


class Overlay:
    """Overlays render a view; those of a user do so too."""

    def __init__(self, visible: float = 100):
        self.scale = price_scale(F.col("end_idx"), visible, F.col("y_min"), F.col("y_max"))

    def render(self, view: DataFrame) -> DataFrame:
        raise NotImplementedError

    def x(self, idx: Column) -> Column:
        return self.scale.x_centre(idx)

    def y(self, price: Column) -> Column:
        return self.scale.y(price)

    def alive(self, rows: DataFrame, view: DataFrame, begin: str, end: str) -> DataFrame:
        """Rows whose life meets the view, with it cut to the view as `cut_from` and `cut_to`; a life without an end goes on."""
        first, last = F.col("first_idx").cast("long"), F.col("end_idx").cast("long")
        until = F.coalesce(F.col(end), last)
        rows = M.with_row(rows, view).where((F.col(begin) <= last) & (until >= first))
        return rows.withColumn("cut_from", F.greatest(F.col(begin), first)).withColumn("cut_to", F.least(until, last))

    def shown(self, rows: DataFrame, view: DataFrame, at: str = "idx") -> DataFrame:
        """Rows at a bar of the view."""
        return M.with_row(rows, view).where(F.col(at).between(F.col("first_idx").cast("long"), F.col("end_idx").cast("long")))


class Liquidity(Overlay):
    """liquidity_states: a line from each level's swing to the bar that passes it, and how it was resolved at that bar."""

    def __init__(self, levels: DataFrame, visible: float = 100):
        super().__init__(visible)
        self.levels = levels

    def render(self, view: DataFrame) -> DataFrame:
        y, color = self.y(F.col("price")), F.when(F.col("side") == "BUY", M.BUY_SIDE).otherwise(M.SELL_SIDE)
        lines = self.alive(self.levels, view, "level_idx", "swept_idx")
        out = []
        for side, kind in (("BUY", "bsl"), ("SELL", "ssl")):
            out.append(M.marks_of(lines.where(F.col("side") == side), "price", kind, self.x(F.col("cut_from")), y, self.x(F.col("cut_to")), y, color))
        swept = self.shown(self.levels.where("kind IS NOT NULL"), view, "swept_idx")
        return M.unioned([*out, M.marks_of(swept, "price", "sweep", self.x(F.col("swept_idx")), y, None, None, color, F.col("kind"))])


class Zones(Overlay):
    """mitigated_zones: a box from the zone's bar to the one that meets it, with its opacity as text."""

    def __init__(self, zones: DataFrame, visible: float = 100):
        super().__init__(visible)
        self.zones = zones

    def render(self, view: DataFrame) -> DataFrame:
        rows = self.alive(self.zones, view, "idx", "mitigated_idx")
        color = F.when(F.col("zone") == "DEMAND", M.DEMAND).otherwise(M.SUPPLY)
        return M.marks_of(rows, "price", "zone", self.x(F.col("cut_from")), self.y(F.col("top")), self.x(F.col("cut_to")), self.y(F.col("bottom")), color, format_fixed(F.col("alpha"), 2))


class Vwap(Overlay):
    """session_vwap or anchored_vwap: a line through the values of the view."""

    def __init__(self, values: DataFrame, visible: float = 100):
        super().__init__(visible)
        self.values = values

    def render(self, view: DataFrame) -> DataFrame:
        lines = M.polyline(self.shown(self.values, view), self.scale, "vwap")
        return M.marks_of(lines, "price", "vwap", F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(M.VWAP_LINE))


class Profile(Overlay):
    """A volume profile of the view's own bars: boxes from the right edge, the fullest a quarter of the plot wide, and lines at the middle of the POC's
    bin and at the ends of the value area."""

    def __init__(self, bars: DataFrame, width: float = 10.0, visible: float = 100):
        super().__init__(visible)
        self.bars, self.width = bars, width

    def render(self, view: DataFrame) -> DataFrame:
        bins = spread_profile(self.shown(self.bars, view).withColumn("segment", F.lit(0).cast("long")), self.width)
        most = bins.agg(F.max("volume").alias("most"))
        right, color = F.lit(float(self.scale.width)), F.lit(M.PROFILE)
        rows = M.with_row(M.with_row(bins, most), view)
        boxes = M.marks_of(rows, "price", "profile", right - self.scale.width / 4 * F.col("volume") / F.col("most"), self.y((F.col("bin") + 1) * self.width), right, self.y(F.col("bin") * self.width), color)
        area = M.with_row(grown_area(bins), view)
        ends = (("poc", F.col("poc") + 0.5), ("val", F.col("val")), ("vah", F.col("vah") + 1))
        return M.unioned([boxes, *(M.marks_of(area, "price", kind, F.lit(0), self.y(at * self.width), right, self.y(at * self.width), color) for kind, at in ends)])


class Signals(Overlay):
    """signals: BUY below its bar, SELL above it."""

    def __init__(self, signals: DataFrame, bars: DataFrame, visible: float = 100):
        super().__init__(visible)
        self.signals, self.bars = signals, bars

    def render(self, view: DataFrame) -> DataFrame:
        rows = self.shown(self.signals.join(self.bars.select("series", "idx", "high", "low"), ["series", "idx"]), view)
        buy = F.col("signal") == "BUY"
        return M.marks_of(rows, "price", "signal", self.x(F.col("idx")), self.y(F.when(buy, F.col("low")).otherwise(F.col("high"))), None, None, F.when(buy, M.UP).otherwise(M.DOWN), F.col("signal"))


def overlay_marks(bars: DataFrame, overlays: list[Overlay], visible: float = 100, offset: float = 0) -> DataFrame:
    """The marks of overlays in a view on the bars."""
    view = M.with_row(M.view_bounds(bars, visible, offset), price_range(M.viewed(bars, visible, offset)))
    return M.unioned([o.render(view) for o in overlays])


def full_frame(bars: DataFrame, overlays: list[Overlay], visible: float = 100, offset: float = 0, cursors: DataFrame | None = None) -> DataFrame:
    """frame with the marks of overlays."""
    return M.frame(bars, visible, offset, cursors).unionByName(overlay_marks(bars, overlays, visible, offset))

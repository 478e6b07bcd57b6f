"""The affine maps between bars and pixels; methods give Column expressions or plain numbers alike, and ends and offset may be columns too,
so that a scale can come from a row of the same plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    """Defaults stand in for 0 too in width, height, visible and y_max, but not in margins."""

    width: float = 800
    height: float = 400
    visible: float = 100
    offset: float | Column = 0
    y_min: float | Column = 0
    y_max: float | Column = 1
    left: float = 0
    right: float = 65
    top: float = 10
    bottom: float = 25

    def __post_init__(self):
        for name, default in (("width", 800), ("height", 400), ("visible", 100), ("y_max", 1)):
            value = getattr(self, name)
            if isinstance(value, Column):
                object.__setattr__(self, name, F.when(value == 0, F.lit(float(default))).otherwise(value))
            elif not value:
                object.__setattr__(self, name, default)

    @property
    def bar_width(self) -> float:
        return (self.width - self.left - self.right) / self.visible

    def x_left(self, index):
        return self.left + (index - self.offset) * self.bar_width

    def x_centre(self, index):
        return self.x_left(index) + self.bar_width / 2

    def index_float(self, x):
        return (x - self.left) / self.bar_width + self.offset

    def index(self, x):
        """Rounded from left edges, while bars stand at centres: a bar's centre gives the next bar."""
        near = (x - self.left) / self.bar_width + 0.5
        return (near.cast("long") if isinstance(near, Column) else int(near)) + self.offset

    def y(self, value):
        return self._unless_flat(value, lambda span, inner: self.height - self.bottom - (value - self.y_min) / span * inner)

    def value(self, y):
        return self._unless_flat(y, lambda span, inner: self.y_min + (self.height - self.bottom - y) / inner * span)

    def _unless_flat(self, given, mapped):
        """0 where the range is empty."""
        span, inner = self.y_max - self.y_min, self.height - self.top - self.bottom
        if isinstance(span, Column):
            return F.when(span == 0, F.lit(0.0)).otherwise(mapped(span, inner))
        if not span:
            return F.lit(0.0) if isinstance(given, Column) else 0
        return mapped(span, inner)


def price_scale(end: float | Column, visible: float, low: float | Column, high: float | Column, width: float = 800, height: float = 400) -> Scale:
    visible = visible or 100
    return Scale(width, height, visible, end - visible + 1, low, high, 0, 0, 15, 15)


def atr_scale(end: float | Column, visible: float, low: float | Column, high: float | Column, width: float = 800, height: float = 160, left: float = 0) -> Scale:
    visible = visible or 100
    return Scale(width, height, visible, end - visible + 1, low, high, left, 0, 0, 0)

"""The state of a view and how actions change it: plain values, and a fold over a table of sessions."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame

from ohlspark.operators.folds import Fold
from ohlspark.schema import TIMEFRAMES, VISIBLE_AFTER_RESET, VISIBLE_AT_START


@dataclass(frozen=True)
class View:
    visible: float = VISIBLE_AT_START
    offset: float = 0
    auto: bool = True
    y: tuple[float, float] | None = (0.0, 100.0)
    atr_auto: bool = True
    atr_y: tuple[float, float] | None = (0.0, 10.0)
    tf: str = "1m"


def _half_away(v: float) -> int:
    return int(v + (0.5 if v >= 0 else -0.5))


def clamped(offset: float, visible: float, n: int) -> float:
    """At least -(visible - 2) and at most n - 2; the upper bound comes last and wins."""
    return min(max(offset, -(visible - 2)), n - 2)


def zoom(v: View, n: int, delta: float, x: float = 0, ctrl: bool = False, width: float | None = 800, left: float = 0, right: float = 0) -> View:
    """A tenth of the bars, at least one, fewer for delta > 0; never under two. ctrl keeps the bar under x in place."""
    change = max(1, v.visible * 0.1)
    new = max(2, v.visible - change if delta > 0 else v.visible + change)
    if width is None:
        return replace(v, visible=new)
    offset = v.offset
    if ctrl:
        plot = width - left - right
        plot = plot if plot > 0 else 1
        exact = (x - left) / (plot / v.visible) + (n - v.visible - v.offset)
        offset = n - new - (exact - (x - left) / (plot / new))
    return replace(v, visible=new, offset=clamped(offset, new, n))


def vertical_zoom(v: View, factor: float, atr: bool = False) -> View:
    auto, ends = (v.atr_auto, v.atr_y) if atr else (v.auto, v.y)
    if auto or ends is None:
        return v
    d = 0.05 * (ends[1] - ends[0]) * factor
    return replace(v, **{"atr_y" if atr else "y": (ends[0] - d, ends[1] + d)})


def pan(v: View, n: int, dx: float, width: float = 800) -> View:
    bars = int(dx / (width / v.visible))
    return replace(v, offset=clamped(v.offset + bars, v.visible, n)) if bars else v


def vertical_pan(v: View, dy: float, height: float = 400, atr: bool = False) -> View:
    auto, ends = (v.atr_auto, v.atr_y) if atr else (v.auto, v.y)
    if auto or ends is None:
        return v
    d = dy / (height or 400) * (ends[1] - ends[0])
    return replace(v, **{"atr_y" if atr else "y": (ends[0] + d, ends[1] + d)})


def drag_time_axis(v: View, dx: float) -> View:
    """Rounded; the offset is not held within bounds again. No move changes nothing."""
    if not dx:
        return v
    return replace(v, visible=_half_away(max(2, v.visible * (1 - 0.005 * dx))))


def drag_value_axis(v: View, dy: float, atr: bool = False) -> View:
    auto, ends = (v.atr_auto, v.atr_y) if atr else (v.auto, v.y)
    if auto or ends is None:
        return v
    half = (ends[1] - ends[0]) * max(0.01, 1 + 0.005 * dy) / 2
    middle = (ends[0] + ends[1]) / 2
    return replace(v, **{"atr_y" if atr else "y": (middle - half, middle + half)})


def press(v: View, n: int, key: str) -> View:
    if key == "Left" and v.offset < n - 2:
        return replace(v, offset=v.offset + 1)
    if key == "Right" and v.offset > -(v.visible - 2):
        return replace(v, offset=v.offset - 1)
    return reset(v) if key in ("r", "R") else v


def reset(v: View) -> View:
    return replace(v, visible=VISIBLE_AFTER_RESET, offset=0, auto=True, atr_auto=True, y=None, atr_y=None)


def set_auto(v: View, auto: bool, atr_ends: tuple[float, float] | None = None, ends: tuple[float, float] | None = None) -> View:
    """Going manual keeps the ranges shown just then."""
    if not auto:
        v = replace(v, atr_y=atr_ends or v.atr_y, y=ends or v.y)
    return replace(v, auto=auto, atr_auto=auto)


def set_timeframe(v: View, tf: str) -> View:
    """An unknown timeframe leaves the old one; the view is reset all the same."""
    return replace(reset(v), tf=tf if tf in TIMEFRAMES else v.tf)


def active_panel(y: float, price_height: float = 400, atr_height: float = 160) -> str | None:
    """The panel under a cursor, where the ATR panel lies below the price panel."""
    return "price" if 0 <= y < price_height else "atr" if price_height <= y < price_height + atr_height else None


ACTIONS = {f.__name__: f for f in (zoom, vertical_zoom, pan, vertical_pan, drag_time_axis, drag_value_axis, press, reset, set_auto, set_timeframe)}
_SIZED = {"zoom", "pan", "press"}


def replay(v: View, n: int, events: list[tuple]) -> list[View]:
    """The states after each (action, *arguments)."""
    step = lambda states, e: [*states, ACTIONS[e[0]](states[-1], *([n] if e[0] in _SIZED else []), *e[1:])]
    return reduce(step, events, [v])[1:]


STATES = "session string, step long, action string, visible double, offset double, auto boolean, y_min double, y_max double, atr_min double, atr_max double, tf string"


def traces(actions: DataFrame) -> DataFrame:
    """actions(session, step, n: bars of the series, action, args: json list) -> the states of each session's view after each of its
    actions, in order of step; sessions are independent and each starts with a new view."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, v, out = rows.sort_values("step"), View(), []
        for r in rows.itertuples():
            args = [tuple(a) if isinstance(a, list) else a for a in json.loads(r.args)]
            v = replay(v, int(r.n), [(r.action, *args)])[0]
            out.append((r.session, r.step, r.action, float(v.visible), float(v.offset), v.auto, *(v.y or (None, None)), *(v.atr_y or (None, None)), v.tf))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    return actions.groupBy("session").applyInPandas(fold, STATES)


#: What a recorded action's code stands for; an action of arg is (zoom by its sign, pan or drag by as many pixels).
CODES = {
    0: lambda v, n, arg: press(v, n, "Left"), 1: lambda v, n, arg: press(v, n, "Right"), 2: lambda v, n, arg: zoom(v, n, arg), 3: lambda v, n, arg: pan(v, n, arg),
    4: lambda v, n, arg: drag_time_axis(v, arg), 5: lambda v, n, arg: reset(v),
}


class Recorded(Fold):
    """Recorded sessions as a fold: rows(series: the session, idx: its steps from 0, n: bars of the chart, code, arg) -> the view after each action. In blocks
    (in_blocks) no task works through a whole session, however long."""

    columns, inputs = "visible double, offset double", ("n", "code", "arg")

    def update(self, state: list[float], n: float, code: float, arg: float) -> tuple[tuple, list[float]]:
        visible, offset = state or (VISIBLE_AT_START, 0)
        v = CODES[int(code)](View(visible=visible, offset=offset), int(n), arg)
        return (float(v.visible), float(v.offset)), [v.visible, v.offset]

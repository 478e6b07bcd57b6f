"""Schemas and fixed values of the bar model."""

import logging

FIELDS = ["time", "open", "high", "low", "close", "volume"]
BAR = "series string, tf string, idx long, time timestamp_ntz, open double, high double, low double, close double, volume double"

# Fixed values that results depend on.
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15}
ANCHOR_TYPES = ["SESSION", "BOS", "CHOCH", "POC"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
ATR_PERIOD = 14
VISIBLE_AT_START, VISIBLE_AFTER_RESET = 100, 150
EQ_TOLERANCE = 0.10
TICK = 0.25
GRID_PIXELS = 50


def timeframe_minutes(tf: str) -> int:
    """Minutes of a known timeframe; others are refused."""
    if tf not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {tf!r}: one of {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[tf]


def kept_timeframe(current: str, tf: str) -> str:
    """tf if it is known; an unknown one is told of in the log and leaves the current one."""
    if tf in TIMEFRAMES:
        return tf
    logging.getLogger(__name__).warning("unknown timeframe %r: %s stays", tf, current)
    return current

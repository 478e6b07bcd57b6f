"""Extensions beyond plain bars: swings, gaps, structure, profiles, VWAP and strategy signals.

These follow public definitions; their parameters are ours and stand in the signatures. Bars are as `indexed` makes
them: idx without gaps, and prev_close. Windows over neighbours, last values and running sums are taken in blocks of bars, and
a block is given what it needs of others, so no task orders a whole series. Recursive
ones (SuperTrend, HalfTrend, range filter) are folds over the whole series, in blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ohlspark.functions.scalars import eq_tolerance
from ohlspark.operators.folds import WARM, HalfTrend, RangeFilter, SuperTrend, in_blocks
from ohlspark.schema import ANCHOR_TYPES
from ohlspark.sources.bars import settled


#: Bars of a block that is worked on by itself.
BLOCK = 4096


def _block(idx: Column) -> Column:
    return F.floor(idx / BLOCK)


def _inside(*keys: str) -> WindowSpec:
    return Window.partitionBy("series", "block", *keys).orderBy("idx")


def _with_neighbours(bars: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Bars by `block`, each block with copies of the bars just before and just after it; `own` marks its own."""
    at = F.col("idx")
    blocks = F.array_distinct(F.array(_block(at - after), _block(at), _block(at + before)))
    return bars.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == _block(at))


def _filled(rows: DataFrame, columns: list[str], upto: int = 0) -> DataFrame:
    """For each of the columns a column last_<name>: its last value that isn't null, up to the row, or before it with upto=-1."""
    rows = rows.withColumn("block", _block(F.col("idx")))
    left = rows.groupBy("series", "block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c) for c in columns))
    earlier = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("series", "block", *(F.last(c, True).over(earlier).alias(f"carried_{c}") for c in columns))
    until = _inside().rowsBetween(Window.unboundedPreceding, upto)
    seen = rows.select("*", *(F.last(c, True).over(until).alias(f"seen_{c}") for c in columns)).join(carried, ["series", "block"])
    return seen.select(*(c for c in rows.columns if c != "block"), *(F.coalesce(f"seen_{c}", f"carried_{c}").alias(f"last_{c}") for c in columns))


def swing_points(bars: DataFrame, k: int = 3) -> DataFrame:
    """Bars whose high is above, or low below, those of k bars on both sides; confirmed k bars later. k is at most BLOCK."""
    before, after = _inside().rowsBetween(-k, -1), _inside().rowsBetween(1, k)
    whole = (F.count("*").over(before) == k) & (F.count("*").over(after) == k)
    rows = _with_neighbours(bars.select("series", "idx", "high", "low"), k, k).select(
        "series", "idx", "high", "low", "own", whole.alias("whole"),
        ((F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))).alias("is_high"),
        ((F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))).alias("is_low"),
    ).where("own AND whole AND (is_high OR is_low)")
    kinds = F.array(F.when(F.col("is_high"), F.struct(F.lit("HIGH").alias("type"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit("LOW").alias("type"), F.col("low").alias("price"))))
    return rows.select("series", "idx", F.explode(F.array_compact(kinds)).alias("x"), (F.col("idx") + k).alias("confirmed")).select("series", "idx", "x.type", "x.price", "confirmed")


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Bullish where low is above the high of two bars before, bearish where high is below that low."""
    h2, l2 = F.lag("high", 2).over(_inside()), F.lag("low", 2).over(_inside())
    rows = _with_neighbours(bars.select("series", "idx", "high", "low"), 2).select("series", "idx", "high", "low", "own", h2.alias("h2"), l2.alias("l2")).where("own")
    rows = rows.withColumn("type", F.when(F.col("low") > F.col("h2"), "BULLISH").when(F.col("high") < F.col("l2"), "BEARISH")).where("type IS NOT NULL")
    bull = F.col("type") == "BULLISH"
    return rows.select("series", "idx", "type", F.when(bull, F.col("h2")).otherwise(F.col("high")).alias("bottom"), F.when(bull, F.col("low")).otherwise(F.col("l2")).alias("top"))


def structure_breaks(bars: DataFrame, k: int = 3) -> DataFrame:
    """Closes that cross the last confirmed swing high or low. In the direction of the last break it is a
    BOS, against it a CHOCH; the first is a BOS. A block of bars, with copies of the 2 k before it, sees which swings are confirmed in it; the
    last levels of the blocks before, and then the last side, are carried to it. 2 k is at most BLOCK."""
    before, after = _inside().rowsBetween(-k, -1), _inside().rowsBetween(1, k)
    whole = (F.count("*").over(before) == k) & (F.count("*").over(after) == k)
    high = F.when(whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)), F.col("high"))
    low = F.when(whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)), F.col("low"))
    rows = _with_neighbours(bars.select("series", "idx", "high", "low", "close", "prev_close"), 2 * k).select("series", "block", "idx", "own", "close", "prev_close", high.alias("h"), low.alias("l"))
    rows = rows.select("series", "block", "idx", "own", "close", "prev_close", F.lag("h", k).over(_inside()).alias("h"), F.lag("l", k).over(_inside()).alias("l")).where("own")
    left = rows.groupBy("series", "block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c) for c in ("h", "l")))
    earlier = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("series", "block", *(F.last(c, True).over(earlier).alias(f"carried_{c}") for c in ("h", "l")))
    upto = _inside().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen_h", F.last("h", True).over(upto)).withColumn("seen_l", F.last("l", True).over(upto)).join(carried, ["series", "block"])
    close, pc, high, low = F.col("close"), F.col("prev_close"), F.coalesce("seen_h", "carried_h"), F.coalesce("seen_l", "carried_l")
    side = F.when((close > high) & (pc <= high), 1).when((close < low) & (pc >= low), -1)
    hits = rows.select("series", "idx", side.alias("side"), F.when(side == 1, high).otherwise(low).alias("price")).where("side IS NOT NULL")
    hits = _filled(settled(hits), ["side"], upto=-1)
    kind = F.when(F.col("last_side").isNull() | (F.col("last_side") == F.col("side")), "BOS").otherwise("CHOCH")
    return hits.select("series", "idx", kind.alias("type"), "side", "price")


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the start of the day."""
    w = Window.partitionBy("series", "day").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("series", "idx", (F.sum(typical_price() * F.col("volume")).over(w) / F.sum("volume").over(w)).alias("vwap"))


def anchored_vwap(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors(series, idx, type): each anchor of a known type starts the sums anew; null before the first."""
    marks = anchors.where(F.col("type").isin(ANCHOR_TYPES)).select("series", "idx").distinct().withColumn("anchor", F.lit(1))
    priced = bars.select("series", "idx", (typical_price() * F.col("volume")).alias("pv"), F.col("volume").alias("v")).join(marks, ["series", "idx"], "left")
    priced = settled(priced.withColumn("block", _block(F.col("idx"))))
    until, earlier = Window.unboundedPreceding, -1
    counts = priced.groupBy("series", "block").agg(F.count("anchor").alias("n"))
    passed = counts.select("series", "block", F.coalesce(F.sum("n").over(Window.partitionBy("series").orderBy("block").rowsBetween(until, earlier)), F.lit(0)).alias("passed"))
    rows = priced.withColumn("here", F.count("anchor").over(_inside().rowsBetween(until, 0))).join(passed, ["series", "block"])
    rows = rows.select("series", "idx", "block", "pv", "v", (F.col("passed") + F.col("here")).alias("anchor_id"))
    blocks = Window.partitionBy("series", "anchor_id").orderBy("block").rowsBetween(until, earlier)
    sums = rows.groupBy("series", "anchor_id", "block").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"))
    before = sums.select("series", "anchor_id", "block", *(F.coalesce(F.sum(c).over(blocks), F.lit(0.0)).alias(f"{c}_before") for c in ("pv", "v")))
    w = _inside("anchor_id").rowsBetween(until, 0)
    rows = rows.select("series", "idx", "block", "anchor_id", F.sum("pv").over(w).alias("pv"), F.sum("v").over(w).alias("v")).join(before, ["series", "anchor_id", "block"])
    value = (F.col("pv") + F.col("pv_before")) / (F.col("v") + F.col("v_before"))
    return rows.select("series", "idx", "anchor_id", F.when(F.col("anchor_id") > 0, value).alias("vwap"))


def volume_profile(bars: DataFrame, width: float = 10.0) -> DataFrame:
    """Volume by day and bin of the typical price."""
    return bars.groupBy("series", "day", F.floor(typical_price() / width).cast("long").alias("bin")).agg(F.sum("volume").alias("volume"))


def value_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """By day: the bin of most volume (the lower of equals) and the least and greatest of the bins that, taken
    in order of volume, first reach `share` of the day's volume."""
    order = Window.partitionBy("series", "day").orderBy(F.desc("volume"), "bin")
    whole = Window.partitionBy("series", "day")
    rows = profile.select("*", F.coalesce(F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("volume").over(whole).alias("total"), F.row_number().over(order).alias("nth"))
    inside = rows.where(F.col("before") < share * F.col("total"))
    return inside.groupBy("series", "day").agg(F.max(F.when(F.col("nth") == 1, F.col("bin"))).alias("poc"), F.min("bin").alias("val"), F.max("bin").alias("vah"), F.max("total").alias("volume"))


PROFILES = ("SESSION", "STRUCTURE", "HISTORICAL")


def segments(bars: DataFrame, mode: str, events: DataFrame | None = None) -> DataFrame:
    """bars with a number `segment`: the day since 1970 (SESSION), how many bars with an event, a break of structure where no events are given, there are up to the
    bar (STRUCTURE), or 0 (HISTORICAL). Events are counted by blocks of bars."""
    if mode not in PROFILES:
        raise ValueError(f"mode: one of {', '.join(PROFILES)}")
    if mode == "SESSION":
        return bars.withColumn("segment", F.datediff(F.to_date("time"), F.lit("1970-01-01").cast("date")).cast("long"))
    if mode == "HISTORICAL":
        return bars.withColumn("segment", F.lit(0).cast("long"))
    marks = (structure_breaks(bars) if events is None else events).select("series", "idx").distinct().withColumn("mark", F.lit(1))
    rows = settled(bars.join(marks, ["series", "idx"], "left").withColumn("block", _block(F.col("idx"))))
    counts = rows.groupBy("series", "block").agg(F.count("mark").alias("n"))
    earlier = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    passed = counts.select("series", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("passed"))
    here = F.count("mark").over(_inside().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("here", here).join(passed, ["series", "block"]).select(*bars.columns, (F.col("passed") + F.col("here")).alias("segment"))


def spread_profile(segmented: DataFrame, width: float = 10.0) -> DataFrame:
    """bars(series, segment, high, low, volume) -> series, segment, bin, volume: each bar's volume spread over the bins of price that its range covers, in
    proportion to how much of the range lies in each; all of it in one bin where the range is a point. Rounded to nine digits, as sums differ in their last bits by order."""
    low, high, span = F.col("low"), F.col("high"), F.col("high") - F.col("low")
    rows = segmented.select("series", "segment", "low", "high", "volume", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("bin"))
    covered = F.least(high, (F.col("bin") + 1) * width) - F.greatest(low, F.col("bin") * width)
    part = F.when(span > 0, covered / span).otherwise(1.0) * F.col("volume")
    return rows.withColumn("part", part).where("part > 0").groupBy("series", "segment", "bin").agg(F.round(F.sum("part"), 9).alias("volume"))


def grown_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """By series and segment: poc, the bin of most volume (the lowest of equals), and val and vah, the ends of the area around it that takes in the greater of
    the two bins beside it (the upper of equals) until it holds `share` of the volume; inside, what it holds; volume, the sum. A task holds the bins of a
    segment, which price and width bound, not the number of bars."""

    def grow(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        at, v = bins["bin"].to_numpy(), bins["volume"].to_numpy()
        lo = hi = int(v.argmax())
        total, inside = float(v.sum()), float(v[lo])
        while round(inside, 6) < round(share * total, 6) and (lo > 0 or hi < len(v) - 1):
            above, below = v[hi + 1] if hi < len(v) - 1 else -1.0, v[lo - 1] if lo > 0 else -1.0
            if above >= below:
                hi += 1
            else:
                lo -= 1
            inside += float(max(above, below))
        return pd.DataFrame({"series": bins["series"].iloc[:1], "segment": bins["segment"].iloc[:1], "poc": at[v.argmax()], "val": at[lo], "vah": at[hi], "inside": inside, "volume": total})

    return profile.groupBy("series", "segment").applyInPandas(grow, "series string, segment long, poc long, val long, vah long, inside double, volume double")


#: Children of a node in the tree of extremes.
FAN = 256


def first_hit(levels: DataFrame, bars: DataFrame, hit, exact: bool = True, fan: int = FAN) -> DataFrame:
    """levels(series, after, ...), bars(series, idx, low, high) -> levels with `at`: the first idx beyond `after` for which hit(low, high) holds, a
    condition over columns of the levels; null without one.

    A level climbs a tree of block extremes, up to one root, until a later block may hold such a bar, and descends into it: a join by
    block for each step, whatever the distance. hit must hold for a block's extremes if it does for a bar of it. Where a block's extremes may fulfil it and none of
    its bars does (a range that is jumped over), exact is False: then such a level starts again after the block, until none is left.
    """
    nodes, tree = bars.select("series", F.col("idx").alias("at"), "low", "high"), []
    last = bars.agg(F.max("idx")).first()[0] or 0
    while not tree or last:
        grouped = nodes.groupBy("series", F.floor(F.col("at") / fan).alias("group")).agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("nodes"), F.min("low").alias("low"), F.max("high").alias("high"))
        tree.append(grouped.select("series", "group", "nodes"))
        nodes = grouped.select("series", F.col("group").alias("at"), "low", "high")
        last //= fan
    holds = lambda x: hit(x["low"], x["high"])
    first = lambda found: F.get(found, 0)["at"]

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("place", F.col("after")).withColumn("at", F.lit(None).cast("long")).withColumn("depth", F.lit(len(tree)))
        for k, level in enumerate(tree):
            rows = rows.withColumn("group", F.floor(F.col("place") / fan)).join(level, ["series", "group"], "left")
            here = F.when(F.col("at").isNull(), first(F.filter("nodes", lambda x: (x["at"] > F.col("place")) & holds(x))))
            rows = rows.withColumn("hit", here).withColumn("depth", F.when(F.col("hit").isNotNull(), k).otherwise(F.col("depth")))
            rows = rows.withColumn("at", F.coalesce("at", "hit")).withColumn("place", F.col("group")).drop("group", "nodes", "hit")
        rows = rows.withColumn("missed", F.lit(None).cast("long"))
        for k in range(len(tree) - 1, 0, -1):
            down = (F.col("depth") == k) & F.col("at").isNotNull()
            rows = rows.withColumn("group", F.when(down, F.col("at"))).join(tree[k - 1], ["series", "group"], "left")
            into = first(F.filter("nodes", holds))
            rows = rows.withColumn("missed", F.when(down & into.isNull(), (F.col("group") + 1) * fan**k - 1).otherwise(F.col("missed")))
            rows = rows.withColumn("at", F.when(down, into).otherwise(F.col("at")))
            rows = rows.withColumn("depth", F.when(down, k - 1).otherwise(F.col("depth"))).drop("group", "nodes")
        return rows.drop("place", "depth")

    if exact:
        return found(levels).drop("after", "missed")
    done, open_ = None, levels
    while True:
        rows = settled(found(open_))
        kept = rows.where("missed IS NULL").drop("after", "missed")
        done = kept if done is None else done.unionByName(kept)
        open_ = rows.where("missed IS NOT NULL").withColumn("after", F.col("missed")).drop("at", "missed")
        if open_.isEmpty():
            return done


def first_above(levels: DataFrame, bars: DataFrame, fan: int = FAN) -> DataFrame:
    """levels(series, level_idx, price, after), bars(series, idx, value) -> levels with `at`: the first idx beyond `after` whose
    value is above price, null without one."""
    return first_hit(levels, bars.select("series", "idx", F.col("value").alias("low"), F.col("value").alias("high")), lambda low, high: high > F.col("price"), fan=fan)


def liquidity_states(bars: DataFrame, k: int = 3, hold: int = 3, fan: int = FAN) -> DataFrame:
    """Each swing high as a buy-side and each swing low as a sell-side level: side, state, kind, resolved, resolved_idx.

    DETECTED until a high (low) after its confirmation passes it, however late. Then the closes of that bar and of
    the hold - 1 after it decide: ACCEPTANCE if all of them are beyond the level, RECLAIMED if one is back, SWEPT while there
    are too few to tell. kind: GRAB if the sweeping bar itself closes back, SWEEP if a later one does,
    RUN if none does; resolved once it is known, at the bar resolved_idx. Offsets of bars make the join on closes an equi-join.
    """
    bars = settled(bars.select("series", "idx", "high", "low", "close"))  # read several times, so made once
    both = F.array(F.struct(F.lit("BUY").alias("side"), F.col("high").alias("value"), F.col("close").alias("end")), F.struct(F.lit("SELL").alias("side"), (-F.col("low")).alias("value"), (-F.col("close")).alias("end")))
    sided = bars.select("series", "idx", F.explode(both).alias("x")).select(F.concat_ws(" ", "x.side", "series").alias("series"), "idx", "x.value", "x.end")
    buy = F.col("type") == "HIGH"
    levels = swing_points(bars, k).select(F.concat_ws(" ", F.when(buy, "BUY").otherwise("SELL"), "series").alias("series"), F.col("idx").alias("level_idx"), F.when(buy, F.col("price")).otherwise(-F.col("price")).alias("price"), F.col("confirmed").alias("after"))
    rows = settled(first_above(levels, sided.select("series", "idx", "value"), fan).withColumnRenamed("at", "swept_idx"))
    after = rows.where("swept_idx IS NOT NULL").select("series", "level_idx", "price", F.explode(F.sequence(F.col("swept_idx"), F.col("swept_idx") + hold - 1)).alias("idx"))
    held = F.col("end") > F.col("price")
    closes = after.join(sided.select("series", "idx", "end"), ["series", "idx"]).groupBy("series", "level_idx").agg(
        F.min(held).alias("held"), F.min_by(held, "idx").alias("first"), F.count("*").alias("n"), F.min(F.when(~held, F.col("idx"))).alias("back"), F.max("idx").alias("last")
    )
    rows = rows.join(closes, ["series", "level_idx"], "left")
    run = F.col("held") & (F.col("n") == hold)
    kind = F.when(~F.col("first"), "GRAB").when(~F.col("held"), "SWEEP").when(run, "RUN")
    state = F.when(F.col("swept_idx").isNull(), "DETECTED").when(run, "ACCEPTANCE").when(~F.col("held"), "RECLAIMED").otherwise("SWEPT")
    side = F.substring_index("series", " ", 1)
    return rows.select(
        F.expr("substr(series, instr(series, ' ') + 1)").alias("series"), side.alias("side"), "level_idx", F.abs("price").alias("price"), "swept_idx", state.alias("state"), kind.alias("kind"),
        kind.isNotNull().alias("resolved"), F.when(run, F.col("last")).otherwise(F.col("back")).alias("resolved_idx"),
    )


#: Bars for which a resolved sweep counts as recent.
RECENT = 20


def with_last_sweep(events: DataFrame, levels: DataFrame) -> DataFrame:
    """events(series, idx, ...), at most one a bar and type, levels of liquidity_states -> with the liquidity event that was resolved last, at or before
    their bar (an as-of join by resolved_idx): sweep_side, sweep_kind, sweep_idx (the sweeping bar), sweep_resolved; nulls before the first.
    Of events resolved at one bar the one of the latest level counts, BUY after SELL. Blocks of bars carry one event to the next."""
    seen = levels.where("resolved").groupBy("series", F.col("resolved_idx").alias("idx")).agg(F.max(F.struct("level_idx", F.when(F.col("side") == "BUY", 1).otherwise(0).alias("n"), "side", "kind", "swept_idx", "resolved_idx")).alias("sweep"))
    at = settled(events.select("series", "idx").distinct().join(seen, ["series", "idx"], "full"))
    last = _filled(at, ["sweep"]).select("series", "idx", *(F.col(f"last_sweep.{c}").alias(n) for c, n in (("side", "sweep_side"), ("kind", "sweep_kind"), ("swept_idx", "sweep_idx"), ("resolved_idx", "sweep_resolved"))))
    return events.join(last, ["series", "idx"], "left")


def _recent_rejection(recent: int) -> Column:
    return F.coalesce(F.col("sweep_kind").isin("SWEEP", "GRAB") & (F.col("idx") - F.col("sweep_resolved") <= recent), F.lit(False))


def weighted_breaks(bars: DataFrame, k: int = 3, hold: int = 3, recent: int = RECENT) -> DataFrame:
    """structure_breaks with sweep_idx, sweep_kind and weight: 1, and 1 more if the liquidity event resolved last is a SWEEP or GRAB
    of the last `recent` bars, and 1 more still if it took the side that the break leaves (sell-side before a break upwards)."""
    bars = settled(bars.select("series", "idx", "high", "low", "close", "prev_close"))
    rows = with_last_sweep(structure_breaks(bars, k), liquidity_states(bars, k, hold))
    near = _recent_rejection(recent)
    leaves = F.col("sweep_side") == F.when(F.col("side") == 1, "SELL").otherwise("BUY")
    weight = F.when(near & leaves, 3).when(near, 2).otherwise(1)
    return rows.select("series", "idx", "type", "side", "price", "sweep_idx", "sweep_kind", weight.cast("double").alias("weight"))


def equal_swings(bars: DataFrame, k: int = 3, within: int = 500) -> DataFrame:
    """bars(..., atr) -> pairs of swings of a type, `within` bars of each other, whose prices differ by at most the tolerance at the later one: series, type
    (EQH, EQL), idx, earlier_idx, price, earlier_price.

    A band join: swings meet by stretches of `within` bars, an earlier one in its own and the next, and by bins of price as wide as the
    greatest tolerance of the stretch, an earlier one in its own and both beside it.
    """
    bars = settled(bars.select("series", "idx", "high", "low", "atr"))
    cell = F.floor(F.col("idx") / within)
    swings = settled(swing_points(bars, k).join(bars.select("series", "idx", eq_tolerance(F.col("atr")).alias("tolerance")), ["series", "idx"]).where("tolerance IS NOT NULL").withColumn("cell", cell))
    least = 1e-9  # a stretch without any tolerance still has bins
    width = swings.groupBy("series", "type", "cell").agg(F.greatest(F.max("tolerance"), F.lit(least)).alias("width"))
    binned = lambda c: F.floor(F.col(c) / F.col("width"))
    later = swings.join(width, ["series", "type", "cell"]).select("series", "type", "cell", "idx", "price", "tolerance", binned("price").alias("bin"))
    copies = swings.select("series", "type", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("idx").alias("earlier_idx"), F.col("price").alias("earlier_price"))
    earlier = copies.join(width, ["series", "type", "cell"]).withColumn("bin", binned("earlier_price")).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    met = later.join(earlier, ["series", "type", "cell", "bin"]).where((F.col("earlier_idx") < F.col("idx")) & (F.col("idx") - F.col("earlier_idx") <= within))
    close = F.abs(F.col("price") - F.col("earlier_price")) <= F.col("tolerance")
    return met.where(close).select("series", F.when(F.col("type") == "HIGH", "EQH").otherwise("EQL").alias("type"), "idx", "earlier_idx", "price", "earlier_price")


def equal_levels(pairs: DataFrame) -> DataFrame:
    """Pairs of equal_swings -> levels: each swing follows the latest earlier one that it equals, and the swings that follow one first swing, through others, are
    a level: series, type, level_idx (the first), n, low, high, last_idx. Followed by doubling, so in few rounds however long a level."""
    latest = pairs.groupBy("series", "type", "idx").agg(F.max(F.struct("earlier_idx", "earlier_price")).alias("e"), F.max("price").alias("price"))
    up = settled(latest.select("series", "type", "idx", "price", F.col("e.earlier_idx").alias("to"), F.col("e.earlier_price").alias("to_price")))
    roots = up.select("series", "type", F.col("to").alias("idx"), F.col("to_price").alias("price")).distinct().join(up, ["series", "type", "idx"], "left_anti")
    follow = settled(up.select("series", "type", "idx", "price", "to").unionByName(roots.withColumn("to", F.col("idx"))))
    while True:
        step = follow.select("series", "type", F.col("idx").alias("to"), F.col("to").alias("further"))
        moved = settled(follow.join(step, ["series", "type", "to"]).select("series", "type", "idx", "price", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        follow = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return follow.groupBy("series", "type", F.col("to").alias("level_idx")).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.max("idx").alias("last_idx"))


def supertrend(bars: DataFrame, factor: float = 3.0, block: int = BLOCK, warm: int = WARM) -> DataFrame:
    return in_blocks(SuperTrend(factor), bars, block, warm)


def range_filter(bars: DataFrame, factor: float = 1.5, block: int = BLOCK, warm: int = WARM) -> DataFrame:
    return in_blocks(RangeFilter(factor), bars, block, warm)


def halftrend(bars: DataFrame, deviation: float = 2.0, block: int = BLOCK, warm: int = WARM) -> DataFrame:
    return in_blocks(HalfTrend(deviation), bars, block, warm)


def anchor_events(bars: DataFrame, k: int = 3) -> DataFrame:
    """What a VWAP can be anchored to: the first bar of each day (SESSION) and each break of structure (BOS, CHOCH)."""
    day = bars.groupBy("series", F.to_date("time").alias("day")).agg(F.min_by(F.struct("idx", "open"), "idx").alias("x"))
    sessions = day.select("series", F.col("x.idx").alias("idx"), F.lit("SESSION").alias("type"), F.col("x.open").alias("price"))
    return sessions.unionByName(structure_breaks(bars, k).select("series", "idx", "type", "price"))


def poc_bars(bars: DataFrame, width: float = 10.0) -> DataFrame:
    """bars(series, day, ...) -> series, day, poc, idx: the bar of most volume within the day's bin of most volume, the first of equals."""
    area = value_area(volume_profile(bars, width)).select("series", "day", "poc")
    inside = bars.join(area, ["series", "day"]).where(F.floor(typical_price() / width) == F.col("poc"))
    return inside.groupBy("series", "day", "poc").agg(F.max_by("idx", F.struct("volume", -F.col("idx"))).alias("idx"))


def zones(bars: DataFrame, decay: float = 0.05) -> DataFrame:
    """Demand zones from bullish and supply zones from bearish gaps, with an opacity that falls by `decay` a bar of age."""
    n = bars.groupBy("series").agg(F.max("idx").alias("last"))
    kind = F.when(F.col("type") == "BULLISH", "DEMAND").otherwise("SUPPLY")
    return fair_value_gaps(bars).join(n, "series").select("series", "idx", kind.alias("zone"), "bottom", "top", F.greatest(F.lit(0.0), 1 - decay * (F.col("last") - F.col("idx"))).alias("alpha"))


def mitigated_zones(bars: DataFrame, k: int = 3, hold: int = 3, recent: int = RECENT, fan: int = FAN) -> DataFrame:
    """zones with what later bars do to them: mitigated_idx, the first later bar whose range meets the zone; filled_idx, the first one that goes through to its far
    edge; bottom_left and top_left, what the bars up to the last leave of it (null once it is filled); and reaction, whether a SWEEP or GRAB
    was the liquidity event resolved last, at most `recent` bars before the zone's bar."""
    bars = settled(bars.select("series", "idx", "high", "low", "close"))
    demand = F.col("zone") == "DEMAND"
    found = settled(zones(bars).withColumn("after", F.col("idx")))
    met = first_hit(found, bars, lambda low, high: (low <= F.col("top")) & (high >= F.col("bottom")), False, fan).withColumnRenamed("at", "mitigated_idx")
    passed = lambda low, high: F.when(F.col("zone") == "DEMAND", low <= F.col("bottom")).otherwise(high >= F.col("top"))
    rows = settled(first_hit(met.withColumn("after", F.col("idx")), bars, passed, fan=fan).withColumnRenamed("at", "filled_idx"))
    # the extremes of all bars after the zone's: those of its block's rest and of the blocks behind
    kept = bars.withColumn("block", _block(F.col("idx")))
    rest = _inside().rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy("series").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = kept.groupBy("series", "block").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).select("series", "block", F.min("lo").over(behind).alias("lo"), F.max("hi").over(behind).alias("hi"))
    here = kept.select("series", "idx", "block", F.min("low").over(rest).alias("lo_here"), F.max("high").over(rest).alias("hi_here")).join(blocks, ["series", "block"])
    reach = here.select("series", "idx", F.least("lo", "lo_here").alias("lo"), F.greatest("hi", "hi_here").alias("hi"))
    rows = rows.join(reach, ["series", "idx"])
    open_ = F.col("filled_idx").isNull()
    bottom = F.when(open_, F.when(demand, F.col("bottom")).otherwise(F.greatest("bottom", "hi")))
    top = F.when(open_, F.when(demand, F.least("top", "lo")).otherwise(F.col("top")))
    swept = with_last_sweep(rows, liquidity_states(bars, k, hold, fan))
    return swept.select("series", "idx", "zone", "bottom", "top", "alpha", "mitigated_idx", "filled_idx", bottom.alias("bottom_left"), top.alias("top_left"), _recent_rejection(recent).alias("reaction"))


def signals(bars: DataFrame, k: int = 3) -> DataFrame:
    """Breaks of structure on a bar that also leaves a gap in the same direction: BUY or SELL."""
    gaps = fair_value_gaps(bars).select("series", "idx", F.when(F.col("type") == "BULLISH", 1).otherwise(-1).alias("gap"))
    both = structure_breaks(bars, k).join(gaps, ["series", "idx"]).where("side = gap")
    return both.select("series", "idx", F.when(F.col("side") == 1, "BUY").otherwise("SELL").alias("signal"), F.col("type").alias("reason"))

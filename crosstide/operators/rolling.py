"""Per-entity features over row-count windows.

All windows share one ``(symbol, date)`` spec, so a whole family costs one shuffle by symbol;
``Roller`` evaluates the rolling statistics of a family together.
A symbol has at most one row per calendar date (``sources.tables.dedupe_last`` and the bar
aggregation enforce it), which bounds a window partition by the length of the calendar whatever
the data volume. Each function returns ``{name: Column}`` for one ``withColumns`` call, or a
DataFrame when it needs stacked windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.functions.numeric import TINY, as_col, average_of, clip, ratio
from crosstide.operators.profile import Profile
from crosstide.operators.roller import Roller

LN2 = math.log(2.0)


def entity():
    return Window.partitionBy("symbol").orderBy("date")


def frame(n: int):
    return entity().rowsBetween(-(n - 1), 0)


def lag(c: Column | str, n: int) -> Column:
    return F.lag(as_col(c), n).over(entity())


def lead(c: Column | str, n: int) -> Column:
    return F.lead(as_col(c), n).over(entity())


def half(w: int, floor: int = 3) -> int:
    """Observations a ``w``-row statistic needs: half the window, at least ``floor``."""
    return max(floor, w // 2)


def rolled(fn: Callable[[Column], Column], x: Column | str, w: int, need: int, window=None) -> Column:
    """``fn(x)`` over the last ``w`` rows, NULL with fewer than ``need`` non-null values."""
    window = frame(w) if window is None else window
    x = as_col(x)
    return F.when(F.count(x).over(window) >= need, fn(x).over(window))


def mean(x, w, need, window=None):
    return rolled(F.avg, x, w, need, window)


def std(x, w, need, window=None):
    return rolled(F.stddev_samp, x, w, need, window)


def zscore(x: Column | str, w: int, need: int, window=None) -> Column:
    x = as_col(x)
    return ratio(x - mean(x, w, need, window), std(x, w, need, window))


def change(x: Column | str, n: int) -> Column:
    return ratio(x, lag(x, n)) - 1


# -- price state, returns, momentum -------------------------------------------------------------

def price_state(price: str = "close") -> dict[str, Column]:
    p, o, h, l, c, v = (F.col(n) for n in (price, "open", "high", "low", "close", "volume"))
    dollars = p * v
    span = h - l
    return {
        "log_price": F.log(clip(p, TINY)),
        "dollar_volume": dollars,
        "log_volume": F.log1p(clip(v, 0.0)),
        "log_dollar_volume": F.log1p(clip(dollars, 0.0)),
        "intraday_ret": ratio(c, o) - 1,
        "overnight_ret": ratio(o, lag(p, 1)) - 1,
        "high_low_range": ratio(h, l) - 1,
        "close_location": ratio(c - l, span),
        "open_location": ratio(o - l, span),
        "close_to_high": ratio(c, h) - 1,
        "close_to_low": ratio(c, l) - 1,
    }


def traded_amount() -> dict[str, Column]:
    return {
        "typical_price": average_of([F.col("high"), F.col("low"), F.col("close")]),
        "amount": F.col("volume") * average_of([F.col(n) for n in ("open", "high", "low", "close")]),
    }


def simple_returns(windows: Iterable[int], price: str = "close") -> dict[str, Column]:
    return {f"ret_{w}d": change(price, w) for w in windows}


def log_returns(windows: Iterable[int], log_price: str = "log_price") -> dict[str, Column]:
    return {f"log_ret_{w}d": F.col(log_price) - lag(log_price, w) for w in windows}


def reversals(windows: Iterable[int]) -> dict[str, Column]:
    return {f"rev_{w}d": -F.col(f"ret_{w}d") for w in windows}


def skip_momentum(pairs: Iterable[tuple[int, int]], price: str = "close") -> dict[str, Column]:
    return {f"mom_{look}d_skip_{skip}d": ratio(lag(price, skip), lag(price, look)) - 1
            for skip, look in pairs}


def acceleration(pairs: Iterable[tuple[int, int]]) -> dict[str, Column]:
    return {f"mom_accel_{a}_{b}": F.col(f"ret_{a}d") - F.col(f"ret_{b}d") for a, b in pairs}


def padded_price(price: str = "close") -> Column:
    """Last known price at or before the row, for series with gaps."""
    return F.last(price, ignorenulls=True).over(entity().rowsBetween(Window.unboundedPreceding, 0))


def additivity_gap(log_price: str = "log_price", n: int = 5) -> dict[str, Column]:
    """Gap between ``n`` summed one-step and one ``n``-step log return; needs the column ``log_ret_1d``."""
    direct = F.col(log_price) - lag(log_price, n)
    return {"_additivity_gap": F.abs(rolled(F.sum, "log_ret_1d", n, n) - direct)}


# -- volatility, range, tails -------------------------------------------------------------------

def range_terms() -> dict[str, Column]:
    o, h, l, c = (clip(n, TINY) for n in ("open", "high", "low", "close"))
    hl, co = F.log(h / l), F.log(c / o)
    previous = lag("close", 1)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous),
                            F.abs(F.col("low") - previous))
    return {
        "parkinson_term": hl * hl / F.lit(4 * LN2),
        "gk_term": F.lit(0.5) * hl * hl - F.lit(2 * LN2 - 1) * co * co,
        "true_range_pct": ratio(true_range, "close"),
    }


def signed_part(ret: str, sign: int) -> Column:
    """Returns of one sign, 0 elsewhere; a missing return also counts as 0."""
    r = F.col(ret)
    return F.when((r < 0) if sign < 0 else (r > 0), r).otherwise(0.0)


def return_vols(roll: Roller, windows: Iterable[int], ret: str = "ret_1d") -> dict[str, Column]:
    down, up = (f"{ret}_down", signed_part(ret, -1)), (f"{ret}_up", signed_part(ret, +1))
    out = {}
    for w in windows:
        out[f"vol_{w}d"] = roll.std(ret, w, half(w))
        out[f"downside_vol_{w}d"] = roll.std(down, w, half(w))
        out[f"upside_vol_{w}d"] = roll.std(up, w, half(w))
    return out


def range_vols(roll: Roller, windows: Iterable[int]) -> dict[str, Column]:
    """Needs the ``range_terms`` columns."""
    out = {}
    for w in windows:
        out[f"parkinson_vol_{w}d"] = F.sqrt(clip(roll.mean("parkinson_term", w, half(w)), 0.0))
        out[f"gk_vol_{w}d"] = F.sqrt(clip(roll.mean("gk_term", w, half(w)), 0.0))
        out[f"atr_{w}d"] = roll.mean("true_range_pct", w, half(w))
    return out


def tails(roll: Roller, windows: Iterable[int], ret: str = "ret_1d") -> dict[str, Column]:
    out = {}
    for w in windows:
        out[f"ret_skew_{w}d"] = roll.skewness(ret, w, half(w))
        out[f"ret_kurt_{w}d"] = roll.kurtosis(ret, w, half(w))
        out[f"max_ret_{w}d"] = roll.max(ret, w, half(w))
        out[f"min_ret_{w}d"] = roll.min(ret, w, half(w))
    return out


def vol_ratios(pairs: Iterable[tuple[int, int]]) -> dict[str, Column]:
    return {f"vol_ratio_{a}_{b}": ratio(f"vol_{a}d", f"vol_{b}d") for a, b in pairs}


def drawdowns(roll: Roller, windows: Iterable[int]) -> dict[str, Column]:
    return {f"drawdown_from_{w}d_high": ratio("close", roll.max("close", w, max(5, w // 3))) - 1
            for w in windows}


# -- trend and oscillators ----------------------------------------------------------------------

def averages(roll: Roller, windows: Iterable[int], price: str = "close") -> dict[str, Column]:
    return {f"sma_{w}d": roll.mean(price, w, half(w)) for w in windows}


def average_gaps(windows: Iterable[int], price: str = "close") -> dict[str, Column]:
    """Needs the ``sma_`` columns, which the slope lags once more."""
    out = {}
    for w in windows:
        out[f"sma_gap_{w}d"] = ratio(price, f"sma_{w}d") - 1
        out[f"sma_slope_{w}d"] = change(f"sma_{w}d", w)
    return out


def _smoothed(df: DataFrame, inputs: dict[str, tuple[str, int]]) -> DataFrame:
    """Exponential means ``{output: (input, span)}`` of inputs without NULL, with ``_gap`` rows since the row before.

    One step is an affine map of the last mean. Maps compose, so doubling lags cover
    1, 2, 4 ... steps; a span is done once what is left weighs less than one part in 10**18.
    """
    start, rounds = {}, {}
    for name, (x, span) in inputs.items():
        share = 2.0 / (span + 1)
        kept = F.pow(F.lit(1 - share), F.col("_gap"))
        first = F.col("_gap").isNull()
        start[f"_p_{name}"] = F.when(first, 0.0).otherwise(kept / (kept + share))
        start[name] = F.when(first, F.col(x)).otherwise(share * F.col(x) / (kept + share))
        rounds[name] = max(1, math.ceil(math.log2(18 * math.log(10) / -math.log(1 - share))))
    df = df.withColumns(start)
    for k in range(max(rounds.values())):
        step = {}
        for name in (n for n, last in rounds.items() if k < last):
            p = F.col(f"_p_{name}")
            step[name] = F.col(name) + p * F.coalesce(lag(name, 2 ** k), F.lit(0.0))
            step[f"_p_{name}"] = p * F.coalesce(lag(f"_p_{name}", 2 ** k), F.lit(0.0))
        df = df.withColumns(step)
    return df.drop(*[f"_p_{name}" for name in inputs])


def exponential_trend(df: DataFrame, spans: Iterable[int], macd: tuple[int, int, int],
                      price: str = "close") -> DataFrame:
    """EMA and MACD columns with recursive weights, also across gaps; a missing price keeps the last mean."""
    spans = list(spans)
    fast, slow, signal = macd
    means = {f"ema_{s}d": ("_price", s) for s in dict.fromkeys([*spans, fast, slow])}
    rows = df.select("symbol", "date", F.col(price).cast("double").alias("_price"), F.row_number().over(entity()).alias("_pos"))
    known = rows.where(F.col("_price").isNotNull()).withColumn("_gap", F.col("_pos") - lag("_pos", 1))
    known = _smoothed(known, means).drop("_gap")
    every = known.unionByName(rows.where(F.col("_price").isNull()), allowMissingColumns=True)
    held = entity().rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumns({n: F.last(n, ignorenulls=True).over(held) for n in means})
    every = every.withColumn("_macd", F.col(f"ema_{fast}d") - F.col(f"ema_{slow}d"))
    # the signal starts with the first known price and then takes every row
    every = every.withColumn("_gap", F.when(lag("_macd", 1).isNotNull(), 1))
    every = _smoothed(every, {"_macd_signal": ("_macd", signal)}).select("symbol", "date", *[f"ema_{s}d" for s in spans], "_macd", "_macd_signal")
    out = df.join(every, ["symbol", "date"], "left")
    columns = {f"ema_gap_{s}d": ratio(price, f"ema_{s}d") - 1 for s in spans}
    columns["macd_line"] = ratio("_macd", price)
    columns["macd_signal"] = ratio("_macd_signal", price)
    columns["macd_hist"] = ratio(F.col("_macd") - F.col("_macd_signal"), price)
    return out.withColumns(columns).drop("_macd", "_macd_signal")


def rsi(roll: Roller, windows: Iterable[int], price: str = "close") -> dict[str, Column]:
    """Simple-mean form; NULL when the window has no loss."""
    step = F.col(price) - lag(price, 1)
    gain, loss = ("_gain", clip(step, low=0.0)), ("_loss", -clip(step, high=0.0))
    out = {}
    for w in windows:
        strength = ratio(roll.mean(gain, w, half(w)), roll.mean(loss, w, half(w)))
        out[f"rsi_{w}d"] = F.lit(100.0) - ratio(F.lit(100.0), strength + 1)
    return out


def bollinger(roll: Roller, windows: Iterable[int], price: str = "close") -> dict[str, Column]:
    out = {}
    p = F.col(price)
    for w in windows:
        mid, spread = roll.mean(price, w, half(w, 5)), roll.std(price, w, half(w, 5))
        low = mid - 2 * spread
        band = (mid + 2 * spread) - low
        out[f"boll_z_{w}d"] = ratio(p - mid, spread)
        out[f"boll_bandwidth_{w}d"] = ratio(band, mid)
        out[f"boll_percent_b_{w}d"] = ratio(p - low, band)
    return out


def channels(roll: Roller, windows: Iterable[int], price: str = "close") -> dict[str, Column]:
    out = {}
    p = F.col(price)
    for w in windows:
        top, floor = roll.max("high", w, half(w, 5)), roll.min("low", w, half(w, 5))
        out[f"channel_pos_{w}d"] = ratio(p - floor, top - floor)
        out[f"breakout_high_{w}d"] = ratio(p, top) - 1
        out[f"breakout_low_{w}d"] = ratio(p, floor) - 1
        out[f"williams_r_{w}d"] = ratio((top - p) * -100, top - floor)
    return out


def commodity_channel(roll: Roller, windows: Iterable[int]) -> dict[str, Column]:
    typical = average_of([F.col("high"), F.col("low"), F.col("close")])
    x = ("_typical", typical)
    return {f"cci_approx_{w}d": ratio(typical - roll.mean(x, w, half(w, 5)), roll.std(x, w, half(w, 5)) * 0.015)
            for w in windows}


# -- liquidity ----------------------------------------------------------------------------------

def volume_stats(roll: Roller, windows: Iterable[int]) -> dict[str, Column]:
    """Needs ``dollar_volume`` and ``_volume_ret`` (one-step volume change)."""
    out = {}
    for w in windows:
        out[f"volume_mean_{w}d"] = roll.mean("volume", w, half(w))
        out[f"volume_z_{w}d"] = roll.zscore("volume", w, half(w))
        out[f"volume_ratio_{w}d"] = ratio("volume", roll.mean("volume", w, half(w)))
        out[f"dollar_volume_mean_{w}d"] = roll.mean("dollar_volume", w, half(w))
        out[f"dollar_volume_z_{w}d"] = roll.zscore("dollar_volume", w, half(w))
        out[f"volume_mom_{w}d"] = change("volume", w)
        out[f"volume_vol_{w}d"] = roll.std("_volume_ret", w, half(w))
    return out


def amihud(roll: Roller, windows: Iterable[int]) -> dict[str, Column]:
    daily = ("_amihud", ratio(F.abs("ret_1d"), "dollar_volume"))
    return {f"amihud_{w}d": roll.mean(daily, w, half(w)) for w in windows}


def impact() -> dict[str, Column]:
    return {"ret_per_log_dollar_volume": ratio(F.abs("ret_1d"), "log_dollar_volume")}


# -- market linkage -----------------------------------------------------------------------------

def market_linkage(df: DataFrame, windows: Iterable[int]) -> DataFrame:
    """Rolling beta, correlation, idiosyncratic return and its volatility.

    Covariance uses complete pairs; the variance in beta uses every market value of the frame.
    """
    windows, roll = list(windows), Roller(df)
    out = {}
    for w in windows:
        need = max(20, w // 2)
        out[f"beta_{w}d"] = ratio(roll.cov("ret_1d", "market_ret_1d", w, need),
                                  roll.var("market_ret_1d", w, need))
        out[f"corr_market_{w}d"] = roll.corr("ret_1d", "market_ret_1d", w, need)
    df = roll.finish(out)
    df = df.withColumns({f"idio_ret_{w}d": F.col("ret_1d") - F.col(f"beta_{w}d") * F.col("market_ret_1d")
                         for w in windows})
    roll = Roller(df)
    return roll.finish({f"idio_vol_{w}d": roll.std(f"idio_ret_{w}d", w, max(20, w // 2)) for w in windows})


# -- labels and sequences -----------------------------------------------------------------------

def forward_returns(horizons: Iterable[int], price: str = "close") -> dict[str, Column]:
    return {f"target_ret_fwd_{h}d": ratio(lead(price, h), price) - 1 for h in horizons}


def sequence_windows(df: DataFrame, history: int, horizon: int, fields: list[str]) -> DataFrame:
    """One row per (symbol, date) with full history and future: rows so far, label end, payload arrays and
    future dates. Without fields it is the grid of usable keys."""
    past = entity().rowsBetween(-(history - 1), 0)
    future = entity().rowsBetween(1, horizon)
    payload = [F.collect_list(F.struct("date", *fields)).over(past).alias("history"),
               F.collect_list("date").over(future).alias("future_dates")] if fields else []
    full = df.select("symbol", "date", F.row_number().over(entity()).alias("history_rows"),
                     lead("date", horizon).alias("label_end_date"), *payload)
    return full.where((F.col("history_rows") >= history) & F.col("label_end_date").isNotNull())


# -- whole families -----------------------------------------------------------------------------

def price_momentum(df: DataFrame, p: Profile, price: str = "close") -> DataFrame:
    # returns are taken between last known prices, so a gap counts as no change
    df = df.withColumns(price_state(price) | {"_padded": padded_price(price)})
    df = df.withColumns(simple_returns(p.returns, "_padded") | log_returns(p.returns)
                        | skip_momentum(p.skip_pairs, price)).drop("_padded")
    return df.withColumns(reversals(p.returns) | acceleration(p.accel_pairs))


def volatility(df: DataFrame, p: Profile) -> DataFrame:
    """Needs ``ret_1d``."""
    df = df.withColumns(range_terms())
    roll = Roller(df)
    df = roll.finish(return_vols(roll, p.vols) | range_vols(roll, p.vols) | tails(roll, p.vols)
                     | drawdowns(roll, p.drawdowns))
    return df.withColumns(vol_ratios(p.vol_ratio_pairs)).drop("parkinson_term", "gk_term")


def trend(df: DataFrame, p: Profile, price: str = "close") -> DataFrame:
    roll = Roller(df)
    df = roll.finish(averages(roll, p.averages, price) | rsi(roll, p.rsi, price) | bollinger(roll, p.bollinger, price)
                     | channels(roll, p.channels, price) | commodity_channel(roll, p.cci))
    df = df.withColumns(average_gaps(p.averages, price))
    return exponential_trend(df, p.averages, p.macd, price)


def liquidity(df: DataFrame, p: Profile) -> DataFrame:
    """Needs ``dollar_volume``, ``log_dollar_volume`` and ``ret_1d``."""
    df = df.withColumn("_volume_ret", change("volume", 1))
    roll = Roller(df)
    return roll.finish(volume_stats(roll, p.volumes) | amihud(roll, p.volumes) | impact()).drop("_volume_ret")

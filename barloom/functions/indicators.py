"""Technical indicators as Columns over one window specification: one exchange and one sort serve them all.

Every indicator is defined at every bar from the bars up to it, per symbol in
date order.  ``n`` counts rows, also those with null prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Columns that tell series of bars apart; slices of long histories have a further one.
SERIES = ("symbol",)


def by_symbol(by: tuple = SERIES):
    return Window.partitionBy(*by).orderBy("date")


def last_rows(count: int, by: tuple = SERIES):
    """The window of the last ``count`` bars, the present one among them."""
    return by_symbol(by).rowsBetween(1 - count, 0)


def bar_number(by: tuple = SERIES) -> Column:
    """The bar's number in its series.  A slice has it in the column ``_number``, as its first bars aren't the history's."""
    return F.count(F.lit(1)).over(by_symbol(by).rowsBetween(Window.unboundedPreceding, 0)) if by == SERIES else F.col("_number")


def clean(price: Column) -> Column:
    """NaN as null: engines disagree on how NaN compares."""
    return F.when(~F.isnan(price), price)


def sma(period: int, price: str = "adj_close", by: tuple = SERIES) -> Column:
    """Mean of the non-null prices of the last ``period`` bars; null before there are so many bars."""
    return F.when(bar_number(by) >= period, F.avg(clean(F.col(price))).over(last_rows(period, by)))


def rsi(period: int = 14, price: str = "adj_close", by: tuple = SERIES) -> Column:
    """RSI of simple means.  A change next to a null price is left out, yet the divisor stays; without any loss it is 100."""
    change = clean(F.col(price)) - F.lag(clean(F.col(price))).over(by_symbol(by))
    total = lambda c: F.coalesce(F.sum(c).over(last_rows(period, by)), F.lit(0.0)) / period
    gain, loss = total(F.when(change > 0, change)), total(F.when(change <= 0, F.abs(change)))
    value = F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss)))
    return F.when(bar_number(by) >= period + 1, value)


def avg_volume(period: int = 20, by: tuple = SERIES) -> Column:
    """Truncated mean of the volumes above zero of the last ``period`` bars; null if there are none."""
    traded = F.when(F.col("volume") > 0, F.col("volume").cast("long"))
    total, count = F.sum(traded).over(last_rows(period, by)), F.count(traded).over(last_rows(period, by))
    return F.when(bar_number(by) >= period, F.call_function("div", total, F.when(count > 0, count)))


def atr(period: int = 14, by: tuple = SERIES) -> Column:
    """Mean true range against the adjusted close before; bars with a null among their inputs add nothing, the divisor stays."""
    before = F.lag(clean(F.col("adj_close"))).over(by_symbol(by))
    high, low = clean(F.col("high_price")), clean(F.col("low_price"))
    whole = high.isNotNull() & low.isNotNull() & before.isNotNull()
    reach = F.when(whole, F.greatest(high - low, F.abs(high - before), F.abs(low - before)))
    return F.when(bar_number(by) >= period + 1, F.coalesce(F.sum(reach).over(last_rows(period, by)), F.lit(0.0)) / period)


def recent_high(lookback: int = 21, by: tuple = SERIES) -> Column:
    """Highest positive high of the ``lookback - 1`` bars before the present one."""
    return F.max(F.when(clean(F.col("high_price")) > 0, F.col("high_price"))).over(by_symbol(by).rowsBetween(1 - lookback, -1))


def with_indicators(bars: DataFrame, rsi_period: int = 14, short: int = 20, medium: int = 50, long: int = 200, lookback: int = 21, by: tuple = SERIES) -> DataFrame:
    """``bars`` with n, rsi, sma20, sma50, sma200, avg_volume20, atr14, recent_high and the above_sma flags."""
    wide = bars.withColumns({
        "n": bar_number(by), "rsi": rsi(rsi_period, by=by), "sma20": sma(short, by=by), "sma50": sma(medium, by=by), "sma200": sma(long, by=by),
        "avg_volume20": avg_volume(20, by), "atr14": atr(rsi_period, by), "recent_high": recent_high(lookback, by),
    })
    return wide.withColumns({f"above_{c}": clean(F.col("adj_close")) > F.col(c) for c in ("sma20", "sma50", "sma200")})

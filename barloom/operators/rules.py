"""Rules: Columns over a frame with indicators, and the breakout rule.

A rule names itself and gives three Columns (match, confidence, metadata), so
any number of rules is evaluated in one pass.  A rule that Columns can't
express is a ``BarsRule``: a function of one symbol's bars, which Spark calls
for each symbol (``evaluate_bars``).
"""

from __future__ import annotations

import copy
import dataclasses
import json
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import clean
from ..schemas import SIGNALS


class Rule(Protocol):
    name: str
    version: str

    def snapshot(self) -> str: ...

    def matches(self) -> Column: ...

    def confidence(self) -> Column: ...

    def metadata(self) -> Column: ...


class BarsRule(Protocol):
    """A rule in plain Python: ``signals`` takes a symbol's bars with indicators, by date, and returns those that match, with ``confidence`` and ``metadata``."""

    name: str
    version: str

    def snapshot(self) -> str: ...

    def signals(self, bars: pd.DataFrame) -> pd.DataFrame: ...


@dataclass(frozen=True)
class BreakoutParameters:
    """The thirteen parameters; each must be given or keep its default."""

    lookback_window: int = 21
    rsi_period: int = 14
    sma_short_period: int = 20
    sma_medium_period: int = 50
    sma_long_period: int = 200
    rsi_threshold_match: float = 50.0
    volume_multiplier_match: float = 1.5
    rsi_threshold_confidence: float = 60.0
    volume_multiplier_confidence: float = 2.0
    base_confidence: float = 0.5
    confidence_increment: float = 0.1
    max_confidence_cap: float = 1.0
    max_gap: float = 0.05

    def __post_init__(self):
        missing = [f.name for f in dataclasses.fields(self) if getattr(self, f.name) is None]
        if missing:
            raise ValueError(f"parameters without a value: {', '.join(missing)}")


class BreakoutRule:
    """Close above the recent high by less than the gap, on volume, with strength."""

    name, version = "Breakout Confirmed", "1.1"

    def __init__(self, parameters: BreakoutParameters = BreakoutParameters(), high: str = "recent_high"):
        self.p, self.high = parameters, high

    def reading(self, high: str) -> BreakoutRule:
        """The rule with its recent high in another column."""
        other = copy.copy(self)
        other.high = high
        return other

    def snapshot(self) -> str:
        camel = lambda s: "".join(w.capitalize() if i else w for i, w in enumerate(s.split("_")))
        return json.dumps({camel(k): v for k, v in dataclasses.asdict(self.p).items()}, sort_keys=True, separators=(",", ":"))

    def conditions(self) -> dict[str, Column]:
        """The conditions apart, each null where an input is missing."""
        close, high = clean(F.col("adj_close")), F.col(self.high)
        return {
            "enough_bars": F.col("n") >= self.p.lookback_window,
            "breaks_out": close > high,
            "gap_small": F.try_divide(close - high, high) < self.p.max_gap,
            "volume_confirms": F.col("volume") > F.col("avg_volume20") * self.p.volume_multiplier_match,
            "rsi_strong": F.col("rsi") > self.p.rsi_threshold_match,
            "trend_up": F.col("above_sma20"),
        }

    def matches(self) -> Column:
        whole = None
        for c in self.conditions().values():
            whole = c if whole is None else whole & c
        return F.coalesce(whole, F.lit(False))

    def confidence(self) -> Column:
        """Steps are added in a fixed order, as sums of binary fractions depend on it."""
        step, total = F.lit(self.p.confidence_increment), F.lit(self.p.base_confidence)
        for c in (F.col("rsi") > self.p.rsi_threshold_confidence, F.col("above_sma50"), F.col("volume") > F.col("avg_volume20") * self.p.volume_multiplier_confidence, F.col("above_sma200")):
            total = total + F.when(c, step).otherwise(0.0)
        return F.when(self.matches(), F.least(total, F.lit(self.p.max_confidence_cap))).otherwise(0.0)

    def metadata(self) -> Column:
        return F.to_json(F.struct(F.col("adj_close").alias("close"), "volume", "rsi", "sma20", F.col("avg_volume20").alias("avgVolume20")), {"ignoreNullFields": "false"})


def evaluate(frame: DataFrame, rules: list, scanner_version: str = "1.0", keep: tuple = ()) -> DataFrame:
    """One row per bar and matching rule of a frame with indicators, in the shape of the signals table, and ``keep`` columns of the bar."""
    one = lambda r: F.struct(
        F.lit(r.name).alias("rule_name"), r.matches().alias("matched"), r.confidence().alias("confidence"), F.lit(r.version).alias("rule_version"), F.lit(r.snapshot()).alias("parameter_snapshot"), r.metadata().alias("metadata")
    )
    hits = frame.select("symbol", "date", *keep, F.explode(F.array(*[one(r) for r in rules])).alias("r")).filter("r.matched")
    return hits.select("symbol", F.col("date").alias("scan_date"), "r.rule_name", "r.confidence", F.lit(scanner_version).alias("scanner_version"), "r.rule_version", "r.parameter_snapshot", "r.metadata", *keep)


def one_symbol(rule: BarsRule, scanner_version: str, bars: pd.DataFrame) -> pd.DataFrame:
    """The signals of one symbol's bars in the shape of the signals table."""
    found = rule.signals(bars.sort_values("date"))
    return pd.DataFrame({
        "symbol": found["symbol"], "scan_date": found["date"], "rule_name": rule.name, "confidence": found["confidence"].astype(float),
        "scanner_version": scanner_version, "rule_version": rule.version, "parameter_snapshot": rule.snapshot(), "metadata": found["metadata"],
    })


def evaluate_bars(frame: DataFrame, rule: BarsRule, scanner_version: str = "1.0") -> DataFrame:
    """Signals of a rule in plain Python; one symbol's bars, some thousands, are in memory at a time.  A rule that raises ends the job; ``isolation`` has one that goes on."""
    return frame.groupBy("symbol").applyInPandas(lambda bars: one_symbol(rule, scanner_version, bars), SIGNALS)

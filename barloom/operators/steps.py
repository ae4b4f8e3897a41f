"""Rules with a state of their own, called from SQL.

A ``StepRule`` sees one bar after another and carries what it likes; Spark deals
the bars by symbol and date and calls it through a table function::

    SELECT * FROM trailing_stop(TABLE(SELECT symbol, date, adj_close FROM bars) PARTITION BY symbol ORDER BY date)
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf


class StepRule(Protocol):
    """``begin`` gives the state before a symbol's first bar; ``step`` takes the state and a bar and gives the next state and (action, value), or None where the bar is no signal."""

    name: str

    def begin(self) -> Any: ...

    def step(self, state: Any, bar: Row) -> tuple[Any, tuple[str, float] | None]: ...


@dataclass(frozen=True)
class TrailingStop:
    """Enters at the first bar and leaves where the close has fallen by ``share`` of the highest one since; then it enters again at the next bar."""

    share: float = 0.5
    name: str = "trailing_stop"

    def begin(self) -> float | None:
        return None

    def step(self, state, bar):
        close = bar["adj_close"]
        if close is None or close != close:
            return state, None
        if state is None:
            return close, ("enter", close)
        peak = max(state, close)
        if close < peak * (1 - self.share):
            return None, ("leave", peak)
        return peak, None


def register(spark: SparkSession, rule: StepRule, name: str | None = None) -> str:
    """Register a rule as a table function and return its name.  Its argument is a table with ``symbol``, ``date`` and what the rule reads, partitioned by symbol and ordered by date."""

    class Steps:
        def __init__(self):
            self.state = rule.begin()

        def eval(self, bar: Row):
            self.state, found = rule.step(self.state, bar)
            if found is not None:
                yield bar["symbol"], bar["date"], found[0], float(found[1])

    known = name or rule.name
    spark.udtf.register(known, udtf(Steps, returnType="symbol string, date date, action string, value double"))
    return known


def evaluate(bars: DataFrame, rule: StepRule) -> DataFrame:
    """symbol, date, action, value of a rule over bars."""
    spark = bars.sparkSession
    name = register(spark, rule)
    return spark.sql(f"SELECT * FROM {name}(TABLE({{bars}}) PARTITION BY symbol ORDER BY date)", bars=bars)

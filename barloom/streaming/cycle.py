"""The daily cycle as a stateful stream.

Each symbol's state is the number of its bars, the last 200 of them and the day
up to which it has been scanned; Spark keeps it in the state store, so a
query that stops goes on from its checkpoint.  New bars of a symbol give one window,
the bars held and the new ones, of which the new are evaluated on their days; days without a bar are scanned with the last one,
once the watermark has passed them or the next bar comes.  Windows of a
micro-batch are evaluated by the same Columns as any other scan, and signals,
bars and due outcomes are appended by their natural keys: a batch
that runs twice stores nothing twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.outcomes import HORIZONS, eligible, forward_returns
from ..operators.rules import evaluate
from ..operators.scan import with_rules
from ..operators.slices import SLICED
from ..operators.summary import KEPT
from ..schemas import BARS, OUTCOMES, SIGNALS
from ..sources.manifest import Table
from ..sources.sink import KEYS

_VALUES = [c for c in BARS.names if c not in ("symbol", "date")]
#: A bar of a window: its number in the symbol's history, and of the bars that are to be scanned (_last of their days) the first and the last day.
WINDOWS = "symbol string, date date, " + ", ".join(f"{c} {BARS[c].dataType.simpleString()}" for c in _VALUES) + ", _slice long, _number long, _last boolean, _from date, _until date"
_DAY_MS = 86_400_000
#: A day that isn't there: numpy's NaT.
_NONE = np.iinfo(np.int64).min
#: The symbol of a row that only tells the time.
HEARTBEAT = ""
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _dates(days: np.ndarray) -> pd.Series:
    """Dates of days since 1970."""
    return pd.Series(days.astype("datetime64[D]").astype("datetime64[s]"))


class Held(StatefulProcessor):
    """The last bars of a symbol, and the bars that new ones and passing days ask for: each once, whatever their number."""

    def init(self, handle) -> None:
        self.handle = handle
        # one value, so a symbol costs one look at the store; bars are doubles (the day and the values), NaN for null
        self.held = handle.getValueState("held", "n long, upto int, bars binary")

    def _get(self):
        n, upto, bars = self.held.get() or (0, None, b"")
        return n, upto, np.frombuffer(bars).reshape(-1, 1 + len(_VALUES))

    def _put(self, n: int, upto: int, bars: np.ndarray, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer((before + 1) * _DAY_MS)
        self.held.update((n, upto, bars[-KEPT:].tobytes()))
        self.handle.registerTimer((upto + 1) * _DAY_MS)

    def _window(self, symbol: str, bars: np.ndarray, n: int, first: np.ndarray, until: np.ndarray) -> pd.DataFrame:
        """Bars up to the n-th one; those with a first day to be scanned on are evaluated."""
        columns = {"symbol": np.full(len(bars), symbol, object), "date": _dates(bars[:, 0].astype(np.int64))}
        columns |= {c: bars[:, 1 + i] for i, c in enumerate(_VALUES)}
        columns["volume"] = pd.array(columns["volume"], "Int32")
        marks = {"_slice": np.full(len(bars), first[first != _NONE].min()), "_number": np.arange(n - len(bars) + 1, n + 1), "_last": first != _NONE, "_from": _dates(first), "_until": _dates(until)}
        return pd.DataFrame(columns | marks)

    def handleInputRows(self, key, rows, timerValues):
        (symbol,) = key
        new = pd.concat(list(rows))
        if symbol == HEARTBEAT:
            return
        n, upto, held = self._get()
        days, at = np.unique(np.array(new["date"].tolist(), "datetime64[D]").astype(np.int64), return_index=True)
        if len(held):
            at, days = at[days > upto], days[days > upto]  # the others are of days that have been scanned
        if not len(days):
            return
        bars = np.column_stack([days, new[_VALUES].iloc[at].to_numpy(float, na_value=np.nan)])
        bars = np.concatenate([held, bars])
        # a bar is scanned on its day and on those before the next one
        first, until = np.full(len(bars), _NONE), np.full(len(bars), _NONE)
        first[len(held) :], until[len(held) :] = days, np.append(days[1:] - 1, days[-1])
        if len(held) and upto + 1 < days[0]:
            first[len(held) - 1], until[len(held) - 1] = upto + 1, days[0] - 1
        n += len(days)
        yield self._window(symbol, bars, n, first, until)
        self._put(n, int(days[-1]), bars, upto)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (symbol,) = key
        n, upto, held = self._get()
        if not len(held):
            return
        passed = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        if upto < passed:
            first, until = np.full(len(held), _NONE), np.full(len(held), _NONE)
            first[-1], until[-1] = upto + 1, passed
            yield self._window(symbol, held, n, first, until)
            upto = passed
        self._put(n, upto, held, None)

    def close(self) -> None:
        pass


def windows(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """The windows of a stream of bars; a day is over once a bar of the day after the next ``delay`` has come.  Bars of days that are over are left out."""
    timed = bars.filter("date IS NOT NULL").select(F.coalesce("symbol", F.lit(HEARTBEAT)).alias("symbol"), "date", *_VALUES, F.col("date").cast("timestamp").alias("_at"))
    return timed.withWatermark("_at", delay).groupBy("symbol").transformWithStateInPandas(Held(), WINDOWS, "append", "EventTime")


def signals_of(found: DataFrame, calendar: DataFrame, rules: list) -> DataFrame:
    """Signals of the windows of a batch: those of each window's bars to be scanned, on their trading days."""
    frame, rules = with_rules(found, rules, by=SLICED)
    hits = evaluate(frame.filter("_last"), rules, keep=("_from", "_until"))
    days = calendar.filter("is_trading").select(F.col("date").alias("_day"))
    spread = hits.withColumn("_day", F.explode(F.sequence("_from", "_until"))).join(F.broadcast(days), "_day")
    return spread.select(*[F.col("_day").alias(c) if c == "scan_date" else c for c in SIGNALS.names])


class Tables:
    """Where the cycle's signals and outcomes go."""

    def __init__(self, spark: SparkSession, path: str):
        self.bars = Table(spark, f"{path}/bars", KEYS["stock_prices"], BARS)
        self.signals = Table(spark, f"{path}/signals", KEYS["scan_results"], SIGNALS)
        self.outcomes = Table(spark, f"{path}/outcomes", KEYS["signal_outcomes"], OUTCOMES)


def start(spark: SparkSession, incoming: str, tables: Tables, calendar: DataFrame, checkpoint: str, rules: list, horizons: tuple = HORIZONS, files_at_once: int = 1) -> StreamingQuery:
    """Go through all files of bars that have come since the last run, and stop.

    Signals are appended batch by batch; an outcome is appended in the batch in
    which its horizon's day is seen.  A file with a row whose symbol is null
    and a date alone tells that time has passed.
    """
    spark.conf.set(*STATE_STORE)

    def store(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            new = batch.filter("_last AND _from = date").select(*BARS.names)
            tables.bars.append(new)
            tables.signals.append(signals_of(batch, calendar, rules))
            today = batch.agg(F.max("_until")).first()[0]
            if today is not None:
                due = eligible(tables.signals.read(), calendar, str(today), tables.outcomes.read(), horizons)
                tables.outcomes.append(forward_returns(due, tables.bars.read(), calendar, str(today)))
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", files_at_once).parquet(incoming)
    return windows(stream).writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Rules in plain Python whose failures stay with their symbol.

One pass gives the signals of all symbols and an error row for each symbol
whose rule raised; the error rows go to a quarantine table.
"""

from __future__ import annotations

import traceback

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..schemas import SIGNALS
from ..sources.manifest import Table
from ..storage import work_folder
from .rules import BarsRule, one_symbol

#: What is said of a symbol whose rule failed.
ERRORS = StructType([StructField("symbol", StringType()), StructField("scan_date", DateType()), StructField("rule_name", StringType()), StructField("error", StringType()), StructField("message", StringType())])
_BOTH = StructType([*SIGNALS.fields, StructField("error", StringType()), StructField("message", StringType())])
#: Characters of a message that are kept.
MESSAGE = 500


def evaluate_each(frame: DataFrame, rule: BarsRule, scanner_version: str = "1.0") -> DataFrame:
    """Signals of a rule and, with ``error`` and ``message`` set, a row for each symbol for which it raised: then that symbol has no signals.

    The date of an error row is that of the symbol's last bar.
    """

    def guarded(bars: pd.DataFrame) -> pd.DataFrame:
        try:
            found = one_symbol(rule, scanner_version, bars)
            return found.assign(error=None, message=None)
        except Exception as e:
            said = "".join(traceback.format_exception_only(e)).strip()[:MESSAGE]
            return pd.DataFrame([{c: None for c in _BOTH.names} | {"symbol": bars["symbol"].iloc[0], "scan_date": bars["date"].max(), "rule_name": rule.name, "error": type(e).__name__, "message": said}])[_BOTH.names]

    return frame.groupBy("symbol").applyInPandas(guarded, _BOTH)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, errors) of ``evaluate_each``'s rows."""
    return found.filter("error IS NULL").select(*SIGNALS.names), found.filter("error IS NOT NULL").select(*ERRORS.names)


def quarantine(spark, path: str) -> Table:
    return Table(spark, path, ["symbol", "scan_date", "rule_name"], ERRORS)


def scan_each(frame: DataFrame, rule: BarsRule, signals: Table, errors: Table) -> tuple[int, int]:
    """Evaluate once, append the signals to one table and the failures to another; (signals, failed symbols) that are new."""
    folder = work_folder(frame.sparkSession, "scan")
    evaluate_each(frame, rule).write.parquet(folder)
    found, failed = split(frame.sparkSession.read.schema(_BOTH).parquet(folder))
    return signals.append(found), errors.append(failed)


def without_quarantined(bars: DataFrame, errors: DataFrame, rule_name: str) -> DataFrame:
    """Bars of the symbols for which a rule hasn't failed."""
    return bars.join(errors.filter(F.col("rule_name") == rule_name).select("symbol").distinct(), "symbol", "left_anti")

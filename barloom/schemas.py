"""Tables of the data model, as explicit schemas.

Keys are natural: surrogate numbers aren't reproducible in a distributed write.
"""

from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


BARS = _table(
    symbol=StringType(), date=DateType(), open_price=DoubleType(), high_price=DoubleType(), low_price=DoubleType(),
    close_price=DoubleType(), adj_close=DoubleType(), volume=IntegerType(),
)
UNIVERSE = _table(symbol=StringType(), exchange=StringType(), company_name=StringType(), sector=StringType(), is_active=BooleanType())
SIGNALS = _table(
    symbol=StringType(), scan_date=DateType(), rule_name=StringType(), confidence=DoubleType(), scanner_version=StringType(),
    rule_version=StringType(), parameter_snapshot=StringType(), metadata=StringType(),
)
OUTCOMES = _table(
    symbol=StringType(), scan_date=DateType(), rule_name=StringType(), horizon_days=IntegerType(), entry_price=DoubleType(),
    exit_price=DoubleType(), forward_return=DoubleType(), computed_at=TimestampNTZType(),
)
RUNS = _table(run_date=DateType(), stocks_scanned=IntegerType(), stocks_flagged=IntegerType(), status=StringType(), error_message=StringType())
RUN_FIGURES = _table(
    run_id=StringType(), run_date=DateType(), stocks_scanned=LongType(), stocks_flagged=LongType(), signals_stored=LongType(), status=StringType(), error_message=StringType(), duration_ms=LongType(),
)
STATES = _table(
    trading_date=DateType(), ingestion_status=StringType(), scan_status=StringType(), data_source_status=StringType(), execution_mode=StringType(),
    last_ingestion_time=TimestampNTZType(), last_scan_time=TimestampNTZType(), stocks_ingested=IntegerType(), signals_generated=IntegerType(), error_message=StringType(),
)
CLOSURES = _table(date=DateType(), reason=StringType(), created_at=TimestampNTZType())

"""The seed of the stock universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import UNIVERSE

# Symbol, company and sector of the seeded universe, all on NSE and in use.
SEED = (
    ("RELIANCE", "Reliance Industries", "Energy"),
    ("TCS", "Tata Consultancy Services", "IT"),
    ("HDFCBANK", "HDFC Bank", "Banking"),
    ("INFY", "Infosys", "IT"),
    ("HINDUNILVR", "Hindustan Unilever", "FMCG"),
    ("ICICIBANK", "ICICI Bank", "Banking"),
    ("SBIN", "State Bank of India", "Banking"),
    ("BHARTIARTL", "Bharti Airtel", "Telecom"),
    ("KOTAKBANK", "Kotak Mahindra Bank", "Banking"),
    ("ITC", "ITC Limited", "FMCG"),
    ("LT", "Larsen & Toubro", "Infrastructure"),
    ("AXISBANK", "Axis Bank", "Banking"),
    ("BAJFINANCE", "Bajaj Finance", "Finance"),
    ("ASIANPAINT", "Asian Paints", "Paints"),
    ("MARUTI", "Maruti Suzuki", "Auto"),
    ("HCLTECH", "HCL Technologies", "IT"),
    ("WIPRO", "Wipro", "IT"),
    ("ULTRACEMCO", "UltraTech Cement", "Cement"),
    ("TITAN", "Titan Company", "Consumer"),
    ("SUNPHARMA", "Sun Pharma", "Pharma"),
    ("NESTLEIND", "Nestle India", "FMCG"),
    ("TATAMOTORS", "Tata Motors", "Auto"),
    ("TATASTEEL", "Tata Steel", "Metals"),
    ("POWERGRID", "Power Grid Corp", "Power"),
    ("NTPC", "NTPC", "Power"),
    ("ONGC", "ONGC", "Energy"),
    ("COALINDIA", "Coal India", "Mining"),
    ("M&M", "Mahindra & Mahindra", "Auto"),
    ("BAJAJFINSV", "Bajaj Finserv", "Finance"),
    ("TECHM", "Tech Mahindra", "IT"),
    ("ADANIPORTS", "Adani Ports", "Infrastructure"),
    ("GODREJCP", "Godrej Consumer", "FMCG"),
    ("INDIGO", "InterGlobe Aviation", "Aviation"),
    ("SIEMENS", "Siemens", "Engineering"),
    ("DLF", "DLF", "Real Estate"),
    ("GAIL", "GAIL India", "Gas"),
    ("ABB", "ABB India", "Engineering"),
    ("PIDILITIND", "Pidilite Industries", "Chemicals"),
    ("HAVELLS", "Havells India", "Consumer"),
    ("BERGEPAINT", "Berger Paints", "Paints"),
    ("AMBUJACEM", "Ambuja Cements", "Cement"),
    ("ACC", "ACC Limited", "Cement"),
    ("TATACONSUM", "Tata Consumer", "FMCG"),
    ("DIVISLAB", "Divis Laboratories", "Pharma"),
    ("DRREDDY", "Dr Reddys Labs", "Pharma"),
    ("CIPLA", "Cipla", "Pharma"),
    ("TORNTPHARM", "Torrent Pharma", "Pharma"),
    ("APOLLOHOSP", "Apollo Hospitals", "Healthcare"),
    ("GRASIM", "Grasim Industries", "Cement"),
    ("VEDL", "Vedanta", "Metals"),
)


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(symbol, "NSE", company, sector, True) for symbol, company, sector in SEED], UNIVERSE)


def seed(stored: DataFrame) -> DataFrame:
    """The seed rows that a stored universe hasn't yet, to be appended."""
    return universe(stored.sparkSession).join(stored.select("symbol"), "symbol", "left_anti")

"""quorumlake: a Spark-first analytics engine for voting records and the texts behind them."""

__version__ = "0.1.0"

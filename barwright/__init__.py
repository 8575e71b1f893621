"""Market analytics and strategy backtests as Spark DataFrame programs."""

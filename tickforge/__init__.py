"""tickforge: PySpark-native analytics for OHLCV series and for judging synthetic ones."""

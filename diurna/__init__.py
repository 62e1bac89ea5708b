"""A Spark-native analytics engine for daily rhythms in time series."""

"""tidewell: a Spark-native indicator, time-series and text-corpus engine."""

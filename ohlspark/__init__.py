"""Bar-series analytics on Spark: ticks and bars to indicators, windows, scales and marks."""

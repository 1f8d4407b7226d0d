"""tidecast: automatic forecasting of many series at once, on Spark DataFrames."""

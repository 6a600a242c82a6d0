"""Search-results analytics on Spark: functions from DataFrame to DataFrame."""

"""vigil: time-series anomaly analytics on Spark DataFrames."""

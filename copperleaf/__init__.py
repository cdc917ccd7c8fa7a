"""copperleaf: DataFrame operators for benchmark-contamination analytics on Spark."""

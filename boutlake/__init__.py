"""boutlake: a Spark-native analytics library for contest (two-sided match) logs."""

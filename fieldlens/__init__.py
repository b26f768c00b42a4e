"""fieldlens: a Spark-native engine for nested observation data."""

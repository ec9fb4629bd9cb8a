"""ledgerlark: a Spark-native engine for auditable, time-aware decision data."""

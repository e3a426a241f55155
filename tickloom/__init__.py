"""tickloom: a PySpark-native analytics engine for tick telemetry, event streams and text corpora."""

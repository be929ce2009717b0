"""lorekeep: a PySpark-native analytics engine for annotated text memories."""

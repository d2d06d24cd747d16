"""A PySpark-native analytics engine for evaluating speech enhancement."""

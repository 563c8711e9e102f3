"""memloom: a PySpark-native analytics engine for conversational memory."""

"""Spark-native offline ranking evaluation and experimentation over interaction logs."""

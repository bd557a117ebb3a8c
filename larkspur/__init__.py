"""A PySpark-native machine-learning pipeline and analytics engine."""

"""terrane: a PySpark-native engine for software-ecosystem graphs."""

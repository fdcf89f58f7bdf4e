"""kinelake: a PySpark-native analytics engine for trajectory tables."""

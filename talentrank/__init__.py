"""talentrank: PySpark-native ranking, search and text-processing engine."""

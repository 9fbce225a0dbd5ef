"""souk: PySpark-native operators for regional price-market analytics."""

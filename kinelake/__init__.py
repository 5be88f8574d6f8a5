"""kinelake: a PySpark-native engine for curating and evaluating motion time series and their catalogs."""

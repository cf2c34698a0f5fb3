"""lumasieve: a PySpark-native engine for curating large photo collections."""

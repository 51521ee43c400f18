"""A PySpark-native engine for taxonomic read processing."""

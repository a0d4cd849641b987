"""A PySpark-native engine for mail corpora: parse, clean, extract and render at DataFrame scale."""

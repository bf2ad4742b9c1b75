"""Spark-native engine for notice feeds, ledgers and long documents."""

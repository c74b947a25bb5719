"""Spark-native engine that turns fund documents into a security master."""

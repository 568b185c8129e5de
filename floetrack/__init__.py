"""Spark-native tracking of moving features through time-ordered, georeferenced images."""

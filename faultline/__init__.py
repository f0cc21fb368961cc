"""Failure-log analytics and training-data operations as Spark jobs."""

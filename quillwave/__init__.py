"""Acoustic template matching, its evaluation, its stores and its streams as Spark DataFrame jobs."""

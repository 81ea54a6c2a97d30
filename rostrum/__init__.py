"""Rostrum: competition analytics and corpus preparation as plain PySpark jobs."""

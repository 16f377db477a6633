"""Offline-ranking analytics over impression logs, expressed as Spark DataFrame jobs."""

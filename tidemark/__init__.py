"""Tidemark: point-in-time market-panel analytics and corpus operators on Spark."""

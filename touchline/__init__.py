"""Touchline: match analytics expressed as Spark DataFrame jobs."""

"""Training-data operators: scoring, packing, deduplication, archives and tokenisation on Spark."""

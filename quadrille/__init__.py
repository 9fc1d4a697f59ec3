"""Window-level scoring and dataset quality control on Spark."""

"""Assessment and annotation dataflows for Spark."""

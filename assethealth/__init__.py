"""Asset health and predictive maintenance on Spark."""

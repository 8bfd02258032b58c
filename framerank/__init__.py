"""Frame and event ranking on Spark."""

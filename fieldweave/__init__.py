"""Field zoning and training-data operators on Spark."""

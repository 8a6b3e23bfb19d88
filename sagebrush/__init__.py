"""Decision analytics and training-data operators for Spark."""

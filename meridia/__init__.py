"""Point-in-time equity analytics and training-data preparation on Spark."""

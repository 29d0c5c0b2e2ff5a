"""Contract-checked analytics pipelines and training-data operators on Spark."""

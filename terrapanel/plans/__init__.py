"""Composed jobs: several operators chained over the model's tables."""

"""Column functions over text, JSON and token probabilities."""

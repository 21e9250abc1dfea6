"""A Spark-first engine that turns documents into a graph, and the graph into training data."""

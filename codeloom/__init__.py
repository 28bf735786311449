"""Code-corpus search, graph and lifecycle analytics as Spark DataFrame plans."""

"""quadlake: a Spark-native store and query engine for RDF quads."""

__version__ = "0.1.0"

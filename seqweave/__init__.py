"""seqweave: sequence graphs, node and record embeddings and pair evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"

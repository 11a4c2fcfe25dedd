"""ductwork: planning and auditing of tree-shaped utility networks on Apache Spark."""

__version__ = "0.1.0"

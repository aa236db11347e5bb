"""codeloom: code-graph and text-corpus analytics written for Spark."""

__version__ = "0.1.0"

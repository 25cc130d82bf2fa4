"""corvine: Spark DataFrame operators over code corpora, their graphs, conversations and vectors."""

__version__ = "0.1.0"

"""govlens: governance of AI agents from their data, as Spark DataFrame operators."""

__version__ = "0.1.0"

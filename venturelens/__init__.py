"""venturelens: idea and catalog analytics on Spark."""

__version__ = "0.3.0"

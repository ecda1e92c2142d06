"""tarnwheel: DataFrame operators, query catalogue and evaluation jobs for Spark."""

__version__ = "0.1.0"

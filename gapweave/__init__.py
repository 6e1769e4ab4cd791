"""gapweave: variant, gap and coverage analytics as Spark DataFrame plans."""

__version__ = "0.1.0"

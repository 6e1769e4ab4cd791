"""Training-data operators. Nothing outside this folder imports it, except the
guarded hook in ``__spark_entry__``."""

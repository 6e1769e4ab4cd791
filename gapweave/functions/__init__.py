"""Part of gapweave."""

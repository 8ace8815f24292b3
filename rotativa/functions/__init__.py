"""Part of rotativa."""

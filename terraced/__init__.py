"""Layered data products on Spark: exports, landing, source and domain products, checks."""

from terraced.session import configure, pin, shared_folder, size_shuffles, stored_bytes

__all__ = ["configure", "pin", "shared_folder", "size_shuffles", "stored_bytes"]

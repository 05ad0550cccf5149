"""Column functions: text, digests, numbers and JSON."""

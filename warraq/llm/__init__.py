"""Operators for large-scale training data: links between names, caps, truncation, near-copies, leaks, repeated lines, consistent text, packing, mixing, personal data."""

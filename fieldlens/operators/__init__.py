"""fieldlens operators."""

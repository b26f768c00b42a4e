"""fieldlens functions."""

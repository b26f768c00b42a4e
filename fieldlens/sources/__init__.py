"""fieldlens sources."""

"""fieldlens streaming."""

"""Event feeds as streams."""

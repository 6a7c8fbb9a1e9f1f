"""Views derived from the driver's tables."""

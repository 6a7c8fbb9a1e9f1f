"""Column functions, and the order-dependent rules behind Arrow."""

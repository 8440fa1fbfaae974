"""Text operators for large training collections."""

"""Text functions, as columns and for Arrow batches."""

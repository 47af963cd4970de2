"""Evidence that arrives as a stream."""

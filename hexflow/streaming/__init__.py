"""Extension: the observed traces as a stream."""

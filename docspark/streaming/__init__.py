"""Page analyses as a stream."""

"""corpuskit sources."""

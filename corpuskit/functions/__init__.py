"""corpuskit functions."""

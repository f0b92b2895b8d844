"""corpuskit: document-intelligence operators expressed as Spark jobs."""

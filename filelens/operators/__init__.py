"""DataFrame -> DataFrame operators of the index and search engine."""

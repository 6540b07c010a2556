"""functions of the text and search engine."""

"""The article-local operators over streams of articles."""

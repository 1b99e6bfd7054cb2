"""Part of the search engine; see the README."""

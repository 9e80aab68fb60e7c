"""Composite plans: the search engine and the registered queries."""

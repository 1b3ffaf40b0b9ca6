"""Operators for building training corpora.  Nothing outside this package imports it; it may be removed as a whole."""

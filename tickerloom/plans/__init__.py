"""Composed jobs: the screener and the named queries over the test tables."""

"""Readers and writers: price bars, company filings, ticker lists, universes."""

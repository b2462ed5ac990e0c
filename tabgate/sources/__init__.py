"""Readers: tab-separated files, file listings, vocabulary dumps, stored records, rule rows."""

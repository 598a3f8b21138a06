"""Readers and writers: tables, frequency lists, segmented lists, corpora."""

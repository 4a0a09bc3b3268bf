"""Corpus preparation operators for training data: deduplication, language
identification, URL filters, tokenisation, web archives, vector search and
packing.  Nothing else in the library imports this subpackage."""

"""Operators for preparing large text corpora: encoding, archives, language ID, deduplication, packing, PII, binary
token files and media columns.  Nothing else in the library imports this subpackage."""

"""Readers beyond Spark's own: fixed-width records, paged APIs, files by digest, sniffed CSV."""

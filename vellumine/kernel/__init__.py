"""Decoding and page formatting of one PDF file, in plain Python; nothing here needs Spark."""

"""Builders of PDF files for tests and benchmarks."""

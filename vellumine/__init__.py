"""Document analytics on Spark: PDF batches to Markdown and typed tables."""

__version__ = "0.1.0"

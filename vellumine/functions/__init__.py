"""Column expressions: line shapes, Markdown assembly, codecs."""

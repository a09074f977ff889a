"""Reading files and bytes, writing Markdown and images."""

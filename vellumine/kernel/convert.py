"""One file's bytes to Markdown."""

from __future__ import annotations

from vellumine.kernel.extract import extract
from vellumine.kernel.layout import assemble, format_pages


def convert(data: bytes, page_breaks: bool = False, image_dir: str | None = None) -> tuple[str, list[tuple[str, bytes]]]:
    """(Markdown, images as (file name, bytes)); images only with ``image_dir``. Raises ``PdfError``."""
    found = extract(data, image_dir is not None)
    return assemble(format_pages(found.pages, found.roles), page_breaks, image_dir), found.images

"""One file's bytes to pages of spans and rectangles, images and roles."""

from __future__ import annotations

import heapq
from typing import NamedTuple

from vellumine.kernel import images, structure
from vellumine.kernel.content import Page, Span
from vellumine.kernel.document import Document
from vellumine.kernel.fonts import Font
from vellumine.kernel.objects import Name, PdfError, Ref, Stream

MAX_FORMS, MAX_FORM_BYTES, MAX_FORM_CANDIDATES = 4096, 64 << 20, 16_384


class Extracted(NamedTuple):
    pages: list[tuple[list[Span], list[tuple[float, float, float, float]]]]
    images: list[tuple[str, bytes]]
    roles: dict[tuple[int, int], structure.Role]


def _is_form(doc: Document, ref: Ref) -> bool:
    s = doc.get(ref)
    return isinstance(s, Stream) and isinstance(s.dict.get(b"Subtype"), Name) and s.dict[b"Subtype"] == b"Form"


def collect_forms(doc: Document, page_refs: list[dict[bytes, Ref]], max_forms: int = MAX_FORMS, max_bytes: int = MAX_FORM_BYTES, max_candidates: int = MAX_FORM_CANDIDATES) -> dict[Ref, tuple]:
    """The Forms that pages reach, least numbers first: content, font names and object names, the last two None without own resources."""
    seen: set[Ref] = set()
    waiting: list[Ref] = []
    known: set[Ref] = set()

    def offer(refs) -> None:
        nonlocal waiting
        for ref in refs:
            if ref not in seen and ref not in known and _is_form(doc, ref):
                known.add(ref)
                heapq.heappush(waiting, ref)
                if len(seen) + len(waiting) > max_candidates:
                    last = max(waiting)
                    waiting.remove(last)
                    heapq.heapify(waiting)
                    known.discard(last)

    for refs in page_refs:
        offer(refs.values())
    out: dict[Ref, tuple] = {}
    size = 0
    while waiting and len(out) < max_forms and size < max_bytes:
        ref = heapq.heappop(waiting)
        known.discard(ref)
        seen.add(ref)
        stream = doc.get(ref)
        own = doc.resolve(stream.dict.get(b"Resources"))
        own = own if isinstance(own, dict) else None
        try:
            content = doc.decoded(stream)
        except PdfError:
            continue
        if len(content) > max_bytes - size:
            continue
        size += len(content)
        xobjects = doc.named(own, b"XObject") if own is not None else None
        offer((xobjects or {}).values())
        out[ref] = content, doc.named(own, b"Font") if own is not None else None, xobjects
    return out


def extract(data: bytes, with_images: bool = False) -> Extracted:
    """Raises ``PdfError`` for what is no readable document; damaged parts of one are left out."""
    doc = Document(data)
    resources = [doc.page_resources(p) for p in doc.pages]
    font_refs = [doc.named(r, b"Font") for r in resources]
    object_refs = [doc.named(r, b"XObject") for r in resources]
    forms = collect_forms(doc, object_refs)
    fonts: dict[Ref, Font] = {}

    def font(ref: Ref) -> Font:
        if ref not in fonts:
            fonts[ref] = Font(doc, ref)
        return fonts[ref]

    ready = {ref: (content, None if f is None else {k: font(r) for k, r in f.items()}, x) for ref, (content, f, x) in forms.items()}
    files, names = images.collect(doc, object_refs, [x for _, _, x in forms.values() if x]) if with_images else ([], {})
    pages = []
    for ref, own_fonts, xobjects in zip(doc.pages, font_refs, object_refs):
        page = Page(ready, names)
        content = doc.content(ref)
        if content is not None:
            page.run(content, {k: font(r) for k, r in own_fonts.items()}, xobjects)
        pages.append((page.spans, page.rects))
    return Extracted(pages, files, structure.roles(doc))

"""Explicit schemas of every table."""

from __future__ import annotations

SPAN = "text string, x float, y float, width float, height float, font_size float, bold boolean, italic boolean, mono boolean, kind string, mcid bigint, space_before boolean"
RECT = "x float, y float, w float, h float"
ROLE = "page_idx int, mcid bigint, kind string, level int"
IMAGE = "filename string, bytes binary"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in fields.split(", "))) + ">"


ERROR = "struct<code: string, message: string>"
#: What the decoder gives for one document.
LAYOUT = f"pages array<struct<page_idx: int, spans: array<{_struct(SPAN)}>, rects: array<{_struct(RECT)}>>>, roles array<{_struct(ROLE)}>, images array<{_struct(IMAGE)}>, error {ERROR}"
#: What a conversion gives for one document.
RESULT = f"markdown string, images array<{_struct(IMAGE)}>, error {ERROR}"

SPANS_TABLE = f"doc_id string, page_idx int, seq int, {SPAN}"
RECTS_TABLE = f"doc_id string, page_idx int, seq int, {RECT}"
ROLES_TABLE = f"doc_id string, {ROLE}"
IMAGES_TABLE = f"doc_id string, img_no int, {IMAGE}"

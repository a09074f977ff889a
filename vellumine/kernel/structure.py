"""Roles of marked content from the structure tree of tagged files."""

from __future__ import annotations

from vellumine.kernel.document import Document
from vellumine.kernel.objects import Name, Ref, as_int, as_name

MAX_NODES, MAX_DEPTH = 65_536, 64
ROLES = {b"H": ("heading", 1), b"Title": ("heading", 1), **{b"H%d" % n: ("heading", n) for n in range(1, 7)}} | {
    k: (v, None) for k, v in ((b"Table", "table"), (b"TR", "tr"), (b"TH", "th"), (b"TD", "td"), (b"L", "list"), (b"LI", "list_item"))
}

Role = tuple[str, int | None]


def roles(doc: Document) -> dict[tuple[int, int], Role]:
    """(page, marked content) to the nearest role above it; what the tree names first holds."""
    out: dict[tuple[int, int], Role] = {}
    catalog = doc.catalog()
    if catalog is None or b"StructTreeRoot" not in catalog:
        return out
    number = {ref: i for i, ref in enumerate(doc.pages)}
    seen: set[Ref] = set()

    def page_of(node: dict, page: int | None) -> int | None:
        ref = node.get(b"Pg")
        return number.get(ref, page) if isinstance(ref, Ref) else page

    def put(page: int | None, mcid: int | None, role: Role | None) -> None:
        if page is not None and mcid is not None and mcid >= 0 and role:
            out.setdefault((page, mcid & 0xFFFFFFFF), role)

    def kid(value, page: int | None, role: Role | None, depth: int) -> None:
        if depth > MAX_DEPTH or len(seen) > MAX_NODES:
            return
        if isinstance(value, Ref):
            if value in seen:
                return
            seen.add(value)
            value = doc.get(value)
        if type(value) is int:
            put(page, value, role)
        elif isinstance(value, list):
            for v in value:
                kid(v, page, role, depth + 1)
        elif isinstance(value, dict):
            if isinstance(value.get(b"Type"), Name) and value[b"Type"] == b"MCR":
                put(page_of(value, page), as_int(value.get(b"MCID")), role)
            elif depth + 1 <= MAX_DEPTH and b"K" in value:
                kid(value[b"K"], page_of(value, page), ROLES.get(as_name(value.get(b"S")) or b"", role), depth + 2)

    kid(catalog[b"StructTreeRoot"], None, None, 0)
    return out

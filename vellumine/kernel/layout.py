"""Spans and rectangles of pages to Markdown blocks."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

from vellumine.kernel.content import MARK, Span, octets
from vellumine.kernel.lines import WS, all_caps, heading_level, list_item, named_section, numbered, short_title, strip_number, words
from vellumine.kernel.objects import f32

BINS = 24
MAX_COLUMNS, MAX_ROWS = 12, 48
EPS = 3.0
_TENTH, _NEAR, _INSIDE, _CELL = map(f32, (0.1, 0.45, 0.3, 1.4))


class Line:
    """Spans at one height in order of x; ``y`` is that of the first one seen."""

    __slots__ = ("y", "spans", "_plain")

    def __init__(self, y: float, spans: list[Span]) -> None:
        self.y, self.spans, self._plain = y, spans, None

    @property
    def plain(self) -> str:
        if self._plain is None:
            self._plain = concat([s for s in self.spans if not s.image], False).strip(WS)
        return self._plain


def concat(spans: list[Span], styled: bool) -> str:
    """Texts in order, with the spaces that go before them, emphasised and with image marks if ``styled``."""
    out = ""
    for s in spans:
        if s.image:
            out += f"{MARK}{s.text}{MARK}"
            continue
        if s.space and out and not out.endswith(" "):
            out += " "
        wrap = "*" * (2 * s.bold + s.italic) if styled and s.text.strip(WS) else ""
        out += wrap + s.text + wrap
    return out


def visual_lines(spans: list[Span]) -> list[Line]:
    lines: list[Line] = []
    for s in sorted(spans, key=lambda s: (-s.y, s.x)):
        if lines and f32(abs(lines[-1].y - s.y)) < max(f32(s.size * _NEAR), 2.0):
            lines[-1].spans.append(s)
        else:
            lines.append(Line(s.y, [s]))
    for line in lines:
        line.spans.sort(key=lambda s: s.x)
    return lines


def running_margins(pages: list[list[Span]]) -> set[str]:
    """Texts that are the top of three pages or more, or the bottom of as many."""
    if len(pages) < 3:
        return set()
    tops, bottoms = Counter(), Counter()
    for spans in pages:
        own = [s for s in spans if not s.image]
        if own:
            for count, y in ((tops, max(s.y for s in own)), (bottoms, min(s.y for s in own))):
                band = sorted((s for s in own if f32(abs(s.y - y)) < 6.0), key=lambda s: s.x)
                text = concat(band, False).strip(WS)
                if text and octets(text) < 80:
                    count[text] += 1
    return {t for c in (tops, bottoms) for t, n in c.items() if n >= 3}


def column_gaps(xs: list[float]) -> list[float]:
    """Up to two x at which columns part, from a histogram of the left edges of text."""
    if len(xs) < 8 or f32(max(xs) - min(xs)) < 180.0:
        return []
    low, width = min(xs), f32(max(xs) - min(xs))
    bins = [0] * BINS
    for x in xs:
        bins[min(int(f32(f32(f32(x - low) / width) * BINS)), BINS - 1)] += 1
    few, total, gaps = max(len(xs) // 40, 2), len(xs), []
    for empty, run in groupby(range(1, BINS - 1), key=lambda i: bins[i] <= few):
        run = list(run)
        start, end = run[0], run[-1] + 1
        if empty and len(run) >= 2 and sum(bins[:start]) * 5 >= total and sum(bins[end:]) * 5 >= total:
            middle = f32(start + len(run) // 2 + 0.5)
            gaps.append(f32(low + f32(f32(width * middle) / BINS)))
    return gaps[:2]


def median_size(spans: list[Span]) -> float:
    """Font size at the middle of all bytes of text."""
    sizes = sorted(((s.size, max(octets(s.text), 1)) for s in spans if not s.image and s.size > _TENTH), key=lambda x: x[0])
    total, seen = sum(n for _, n in sizes), 0
    for size, n in sizes:
        seen += n
        if seen * 2 >= total:
            return size
    return 12.0


def cluster(values: list[float], eps: float = EPS) -> list[float]:
    """Means of runs of sorted values that each lie within ``eps`` of the mean so far."""
    out: list[float] = []
    total, n = 0.0, 0
    for v in sorted(values):
        if n and f32(v - f32(total / n)) <= eps:
            total, n = f32(total + v), n + 1
            out[-1] = f32(total / n)
        else:
            total, n = v, 1
            out.append(v)
    return out


def cell_of(edges: list[float], v: float) -> int | None:
    return next((i for i in range(len(edges) - 1) if edges[i] <= v < edges[i + 1]), None)


def gfm(rows: list[list[str]]) -> str | None:
    """A Markdown table; rows are filled up to the widest."""
    wide = max(map(len, rows), default=0)
    if wide < 2:
        return None
    lines = ["| " + " | ".join(c.replace("|", "\\|").strip(WS) for c in row + [""] * (wide - len(row))) + " |" for row in rows]
    lines.insert(1, "|" + " --- |" * wide)
    return "\n".join(lines).rstrip(WS)


def ruled_table(spans: list[Span], rects: list[tuple]) -> tuple[str, tuple[float, float, float, float]] | None:
    """A table between ruling lines or cell boxes, and its box."""
    xs, ys = [], []
    for x, y, w, h in rects:
        if w < 2.5 and h > 8 or h < 2.5 and w > 8 or 8 < w < 280 and 8 < h < 80:
            xs += [x, f32(x + w)]
            ys += [y, f32(y + h)]
    xs, ys = cluster(xs), cluster(ys)
    columns, rows = len(xs) - 1, len(ys) - 1
    if columns < 2 or rows < 2 or columns > MAX_COLUMNS or rows > MAX_ROWS:
        return None
    grid = [[""] * columns for _ in range(rows)]
    for s in spans:
        c, r = cell_of(xs, f32(s.x + f32(s.width * _INSIDE))), cell_of(ys, f32(s.y + f32(s.height * _INSIDE)))
        if s.image or c is None or r is None:
            continue
        row = grid[rows - 1 - r]
        row[c] += (" " if row[c] else "") + s.text.strip(WS)
    filled = _filled(spans, xs, ys)
    if filled < 2 or filled * 5 < rows * columns:
        return None
    made = gfm(grid)
    return (made, (xs[0], ys[0], xs[-1], ys[-1])) if made else None


def _filled(spans: list[Span], xs: list[float], ys: list[float]) -> int:
    """Cells that get text; a blank text leaves its cell empty, so it counts again."""
    full, n = set(), 0
    for s in spans:
        if s.image:
            continue
        place = cell_of(xs, f32(s.x + f32(s.width * _INSIDE))), cell_of(ys, f32(s.y + f32(s.height * _INSIDE)))
        if None not in place and place not in full:
            n += 1
            if s.text.strip(WS):
                full.add(place)
    return n


def split_cells(line: Line) -> list[tuple[float, str]]:
    """(x, text) of the cells of a line: a new one starts well to the right of the start of the last."""
    size = max([12.0, *(s.size for s in line.spans)])
    cells: list[list] = []
    for s in line.spans:
        if s.image:
            continue
        if cells and f32(s.x - cells[-1][0]) < f32(size * _CELL):
            cells[-1][1] += (" " if s.space and not cells[-1][1].endswith(" ") else "") + s.text
        else:
            cells.append([s.x, s.text])
    return [(x, t) for x, t in cells]


def is_row(cells: list[tuple[float, str]]) -> bool:
    if len(cells) < 2 or any(octets(t.strip(WS)) > 48 or words(t) > 8 for _, t in cells):
        return False
    return not (len(cells) == 2 and f32(cells[1][0] - cells[0][0]) > 90 and any(octets(t) > 20 for _, t in cells))


def _aligned(a, b) -> bool:
    return len(a) == len(b) and is_row(b) and all(f32(abs(x - y)) < 18 for (x, _), (y, _) in zip(a, b))


class Column:
    """The text of one column of a page."""

    def __init__(self, spans: list[Span], roles: dict, page: int, median: float) -> None:
        self.lines = visual_lines(spans)
        self.cells = [split_cells(line) for line in self.lines]
        self.rows = [is_row(c) for c in self.cells]
        self.roles, self.page, self.median = roles, page, median

    def _starts_table(self, i: int) -> bool:
        return i + 1 < len(self.lines) and self.rows[i] and _aligned(self.cells[i], self.cells[i + 1])

    def blocks(self) -> list[str]:
        out, i, n = [], 0, len(self.lines)
        while i < n:
            if self._starts_table(i):
                end = i + 1
                while end < n and end - i < MAX_ROWS and _aligned(self.cells[i], self.cells[end]):
                    end += 1
                out.append(gfm([[t for _, t in c] for c in self.cells[i:end]]))
                i = end
                continue
            start, i = i, i + 1
            while i < n:
                size = max([12.0, *(s.size for s in self.lines[i].spans)])
                if f32(abs(self.lines[i - 1].y - self.lines[i].y)) > f32(size * 1.5) or self._starts_table(i):
                    break
                i += 1
            out.append(self.block(self.lines[start:i]))
        return out

    def block(self, lines: list[Line]) -> str:
        if all(s.image or not s.text.strip(WS) for line in lines for s in line.spans):
            return "".join(f"{MARK}{s.text}{MARK}" for line in lines for s in line.spans if s.image)
        items = [list_item(line.plain) for line in lines]
        if None not in items:
            return "\n".join(items)
        if len(lines) > 1 and all(_mono(line) for line in lines):
            return "```\n" + "\n".join(line.plain for line in lines) + "\n```"
        if len(lines) == 1:
            line = lines[0]
            level = self.heading(line)
            return "#" * level + " " + strip_number(line.plain) if level else concat(line.spans, True)
        return paragraph([concat(line.spans, True) for line in lines])

    def heading(self, line: Line) -> int | None:
        role = next((r for s in line.spans if s.mcid is not None and (r := self.roles.get((self.page, s.mcid)))), None)
        if role and role[0] == "heading":
            return min(max(role[1], 1), 6)
        text, median = line.plain, self.median
        if median > _TENTH:
            size = max([0.0, *(s.size for s in line.spans if not s.image)])
            for factor, level in ((1.8, 1), (1.4, 2)):
                if size >= f32(median * f32(factor)) and octets(text) <= 120:
                    return level
            bold = any(s.bold for s in line.spans)
            if bold or size >= f32(median * f32(1.15)):
                if level := heading_level(text):
                    return level
                if bold and short_title(text):
                    return 3
        if numbered(text):
            return heading_level(text)
        return named_section(text) or (2 if all_caps(text) else None)


def _mono(line: Line) -> bool:
    own = [s for s in line.spans if not s.image]
    return bool(own) and all(s.mono for s in own)


def paragraph(lines: list[str]) -> str:
    """Lines joined by spaces; a hyphen before a small letter is taken out."""
    out = lines[0]
    for t in lines[1:]:
        if out.endswith("-") and t[:1].islower():
            out = out[:-1] + t
        else:
            out += (" " if out and not out.endswith(" ") else "") + t
    return out


def join_blocks(parts) -> str:
    return "\n\n".join(p for p in parts if p)


def format_column(spans: list[Span], rects: list[tuple], roles: dict, page: int, median: float) -> str:
    left, right = min(s.x for s in spans), max(f32(s.x + s.width) for s in spans)
    own = [r for r in rects if r[0] < right and f32(r[0] + r[2]) > left]
    found = ruled_table(spans, own) if len(own) >= 3 else None
    if not found:
        return join_blocks(Column(spans, roles, page, median).blocks())
    table, (x0, y0, x1, y1) = found
    rest = [s for s in spans if s.image or f32(s.x + s.width) < f32(x0 - 1) or s.x > f32(x1 + 1) or f32(s.y + s.height) < f32(y0 - 1) or s.y > f32(y1 + 1)]
    if not rest:
        return table
    other = join_blocks(Column(rest, roles, page, median).blocks())
    return join_blocks([other, table] if any(s.y > y1 for s in rest) else [table, other])


def format_page(spans: list[Span], rects: list[tuple], roles: dict, page: int, margins: set[str]) -> str:
    if margins and spans:
        drop = [line.y for line in visual_lines(spans) if line.plain in margins]
        spans = [s for s in spans if s.image or all(f32(abs(s.y - y)) > 2.0 for y in drop)]
    if not spans:
        return ""
    gaps = column_gaps([s.x for s in spans if not s.image])
    columns: dict[int, list[Span]] = {}
    for s in spans:
        n = 0
        while n < len(gaps) and s.x >= gaps[n]:
            n += 1
        columns.setdefault(n, []).append(s)
    median = median_size(spans)
    return join_blocks(format_column(columns[c], rects, roles, page, median) for c in sorted(columns))


_MARKED = re.compile(f"{MARK}([^{MARK}]*){MARK}")


def link_images(markdown: str, folder: str) -> str:
    return _MARKED.sub(lambda m: f"![]({folder.rstrip('/')}/{m[1]})", markdown)


def promote_title(markdown: str) -> str:
    """The first paragraph as a heading, if it is a single line and no heading or image."""
    body = markdown.lstrip(WS)
    head, sep, rest = body.partition("\n\n")
    title = head.strip(WS)
    if not title or body.startswith(("#", "![")) or "\n" in title:
        return markdown
    return markdown[: len(markdown) - len(body)] + "# " + title + sep + rest


def assemble(pages: list[str], page_breaks: bool = False, image_dir: str | None = None) -> str:
    out = ("\n\n---\n\n" if page_breaks else "\n\n").join(p for p in pages if p.strip(WS))
    if image_dir is not None:
        out = link_images(out, image_dir)
    out = promote_title(out)
    return out if out.endswith("\n") else out + "\n"


def format_pages(pages: list[tuple[list[Span], list[tuple]]], roles: dict) -> list[str]:
    margins = running_margins([spans for spans, _ in pages])
    return [format_page(spans, rects, roles, i, margins) for i, (spans, rects) in enumerate(pages)]

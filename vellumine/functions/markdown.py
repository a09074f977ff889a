"""Joining lines, blocks and pages, image links, the title: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.lines import WS, trim

MARK = "\u0001"


def join_blocks(blocks: Column) -> Column:
    """Blocks that aren't empty, a blank line between them."""
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


def join_pages(pages: Column, page_breaks: bool = False) -> Column:
    """Pages that aren't blank, a blank line or a rule between them."""
    return F.array_join(F.filter(pages, lambda p: trim(p) != ""), "\n\n---\n\n" if page_breaks else "\n\n")


def join_paragraph(lines: Column) -> Column:
    """Lines, which hold no line ends, with single spaces between; a hyphen before a small letter goes."""
    glued = F.regexp_replace(F.array_join(lines, "\n"), r"-\n(?=\p{IsLowercase})", "")
    return F.regexp_replace(F.regexp_replace(glued, r"\A\n+", ""), r" ?\n+", " ")


def link_images(markdown: Column, folder: str) -> Column:
    """Marks become image links into ``folder``; a mark without an end stays."""
    safe = folder.rstrip("/").replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(markdown, f"{MARK}([^{MARK}]*){MARK}", f"![]({safe}/$1)")


def promote_title(markdown: Column) -> Column:
    """The first paragraph as a heading, if it is one line and no heading or image."""
    body = F.regexp_replace(markdown, rf"\A[{WS}]+", "")
    head = F.substring_index(body, "\n\n", 1)
    title = trim(head)
    rest = F.substring(body, F.char_length(head) + 1, F.char_length(body))
    lead = F.substring(markdown, F.lit(1), F.char_length(markdown) - F.char_length(body))
    keep = (title == "") | body.startswith("#") | body.startswith("![") | title.contains("\n")
    return F.when(keep, markdown).otherwise(F.concat(lead, F.lit("# "), title, rest))


def end_line(markdown: Column) -> Column:
    return F.when(markdown.endswith("\n"), markdown).otherwise(F.concat(markdown, F.lit("\n")))


def gfm_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: trim(F.replace(c, F.lit("|"), F.lit("\\|")))), " | "), F.lit(" |"))


def gfm_table(rows: Column) -> Column:
    """A Markdown table from an array of rows of cells, filled up to the widest; null below two columns."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    filled = F.transform(rows, lambda r: gfm_row(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r)))))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))
    return F.when(wide >= 2, F.array_join(F.concat(F.slice(filled, 1, 1), F.array(rule), F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0)))), "\n"))

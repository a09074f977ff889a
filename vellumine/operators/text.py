"""Plain text to Markdown, all in expressions: one narrow step for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import markdown as M


def text_blocks(text: Column) -> Column:
    """Array of blocks, each an array of trimmed lines; blank lines part them."""
    whole = F.array_join(F.transform(F.split(text, "\n"), lambda x: L.trim(x)), "\n")
    return F.transform(F.filter(F.split(whole, "\n\n+"), lambda b: F.regexp_like(b, F.lit("[^\n]"))), lambda b: F.split(F.trim(b, F.lit("\n")), "\n"))


def format_block(block: Column) -> Column:
    """A block of body text: a list, a heading, or a paragraph."""
    only = F.get(block, F.lit(0))
    level = L.body_heading(only)
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), L.strip_number(only))
    return (
        F.when(F.forall(block, lambda x: L.is_list_item(x)), F.array_join(F.transform(block, lambda x: L.list_item(x)), "\n"))
        .when((F.size(block) == 1) & level.isNotNull(), heading)
        .otherwise(M.join_paragraph(block))
    )


def text_page(text: Column) -> Column:
    """Markdown of one page of plain text, as its layout would give it."""
    return M.join_blocks(F.transform(text_blocks(text), lambda b: format_block(b)))


def finish(df: DataFrame, pages: Column, name: str = "markdown", page_breaks: bool = False, image_dir: str | None = None) -> DataFrame:
    """``df`` with the document that the pages make: joined, images linked, title promoted, a line end at the end.

    Each step is a column of its own, so that what it takes from the one before
    several times is worked out once.
    """
    out = df.withColumn("__m", M.join_pages(pages, page_breaks))
    if image_dir is not None:
        out = out.withColumn("__m", M.link_images(F.col("__m"), image_dir))
    return out.withColumn("__m", M.promote_title(F.col("__m"))).withColumn(name, M.end_line(F.col("__m"))).drop("__m")

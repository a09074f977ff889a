"""Shapes of a line of text as column expressions; lengths are in bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \\s is ASCII only.
WS = r"\t-\r \u0085   -     　"
_NUMBER = rf"^([0-9]+(?:\.[0-9]+)*)\.?[{WS}]+"
_BULLET = rf"^[-*•◦▪‣⁃][{WS}]+"
_ORDERED = rf"^([0-9]+)[.)][{WS}]+"
_SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SECTIONS = {"Abstract": 3, "Introduction": 1, **{s: 2 for s in ("References", "Bibliography", "Conclusion", "Conclusions", "Acknowledgements", "Acknowledgments", "Related Work", "Related Works")}}


def trim(c: Column) -> Column:
    """Looks at the ends only, whatever the length."""
    return F.btrim(c, F.lit(_SPACES))


def word_count(c: Column) -> Column:
    """Runs of other than white space."""
    t = trim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, rf"[{WS}]+")))


def heading_shaped(c: Column) -> Column:
    return (F.octet_length(c) <= 120) & ~c.endswith(".") & ~c.endswith(",")


def all_caps(c: Column) -> Column:
    return heading_shaped(c) & c.rlike(r"\p{IsAlphabetic}") & ~c.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]") & (word_count(c) <= 12)


def numbered(c: Column) -> Column:
    return c.rlike(_NUMBER)


def short_title(c: Column) -> Column:
    return heading_shaped(c) & (F.octet_length(c) <= 80) & (word_count(c) <= 10)


def heading_level(c: Column) -> Column:
    dots = F.length(F.regexp_replace(F.regexp_extract(c, _NUMBER, 1), "[0-9]", ""))
    return F.when(
        heading_shaped(c),
        F.when(numbered(c), F.least(dots + 1, F.lit(6)))
        .when(all_caps(c), F.lit(2))
        .when(short_title(c) & c.rlike(r"^\p{IsUppercase}") & ~c.contains(";"), F.lit(3)),
    ).cast("int")


def strip_number(c: Column) -> Column:
    return F.regexp_replace(c, _NUMBER, "")


def named_section(c: Column) -> Column:
    t, out = trim(c), None
    for name, level in SECTIONS.items():
        out = F.when(t == name, F.lit(level)) if out is None else out.when(t == name, F.lit(level))
    return out.cast("int")


def is_list_item(c: Column) -> Column:
    return c.rlike(_BULLET) | c.rlike(_ORDERED)


def list_item(c: Column) -> Column:
    """A list item in Markdown; other lines as they are."""
    return (
        F.when(c.rlike(_BULLET), F.concat(F.lit("- "), trim(F.regexp_replace(c, _BULLET, ""))))
        .when(c.rlike(_ORDERED), F.concat(F.regexp_extract(c, _ORDERED, 1), F.lit(". "), trim(F.regexp_replace(c, _ORDERED, ""))))
        .otherwise(c)
    )


def body_heading(c: Column) -> Column:
    """Level of a line of body size that isn't bold and has no role."""
    return F.when(numbered(c), heading_level(c)).otherwise(F.coalesce(named_section(c), F.when(all_caps(c), F.lit(2)))).cast("int")


def font_style(c: Column) -> Column:
    """struct(bold, italic, mono) from a font's name."""
    n = F.lower(c)
    return F.struct(n.rlike("bold|black|heavy").alias("bold"), n.rlike("italic|oblique").alias("italic"), n.rlike("courier|mono|consolas|menlo|monaco|lucidaconsole").alias("mono"))


def emphasis(text: Column, bold: Column, italic: Column) -> Column:
    """Text between asterisks; blank text as it is."""
    wrap = F.when(trim(text) == "", F.lit("")).otherwise(F.concat(F.when(bold, F.lit("**")).otherwise(F.lit("")), F.when(italic, F.lit("*")).otherwise(F.lit(""))))
    return F.concat(wrap, text, wrap)

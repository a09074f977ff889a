"""What one line of text is: a heading of some level, a list item, or prose. Lengths are in bytes of UTF-8."""

from __future__ import annotations

import re

import regex

from vellumine.kernel.content import octets

#: White space as Unicode defines it, which is less than Python's.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = "[" + re.escape(WS) + "]"
_SPLIT = re.compile(_WS + "+")
_NUMBERED = re.compile(rf"([0-9]+(?:\.[0-9]+)*)\.?{_WS}+")
_BULLET = re.compile(rf"[-*•◦▪‣⁃]{_WS}+")
_ORDERED = re.compile(rf"([0-9]+)[.)]{_WS}+")
#: Letters, and those that aren't capital, by Unicode's properties.
_LETTER, _SMALL = regex.compile(r"\p{Alphabetic}"), regex.compile(r"(?V1)[\p{Alphabetic}--\p{Uppercase}]")
SECTIONS = {"Abstract": 3, "Introduction": 1} | dict.fromkeys("References|Bibliography|Conclusion|Conclusions|Acknowledgements|Acknowledgments|Related Work|Related Works".split("|"), 2)


def words(text: str) -> int:
    return len([w for w in _SPLIT.split(text) if w])


def heading_shaped(line: str) -> bool:
    return octets(line) <= 120 and not line.endswith((".", ","))


def all_caps(line: str) -> bool:
    return bool(_LETTER.search(line)) and not _SMALL.search(line) and heading_shaped(line) and words(line) <= 12


def numbered(line: str) -> bool:
    return _NUMBERED.match(line) is not None


def short_title(line: str) -> bool:
    return heading_shaped(line) and octets(line) <= 80 and words(line) <= 10


def heading_level(line: str) -> int | None:
    if not heading_shaped(line):
        return None
    if m := _NUMBERED.match(line):
        return min(m[1].count(".") + 1, 6)
    if all_caps(line):
        return 2
    return 3 if short_title(line) and line[:1].isupper() and ";" not in line else None


def strip_number(line: str) -> str:
    m = _NUMBERED.match(line)
    return line[m.end() :].lstrip(WS) if m else line


def named_section(line: str) -> int | None:
    return SECTIONS.get(line.strip(WS))


def list_item(line: str) -> str | None:
    """The line as a Markdown list item, if it is one."""
    if m := _BULLET.match(line):
        return "- " + line[m.end() :].strip(WS)
    if m := _ORDERED.match(line):
        return f"{m[1]}. " + line[m.end() :].strip(WS)
    return None

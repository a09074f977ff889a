"""Glyph names and the base encodings of simple fonts, built from Unicode's own names and Python's codecs."""

from __future__ import annotations

import unicodedata
from functools import cache

_MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌"}
_ACCENTED = {"grave": "AEIOUaeiou", "acute": "AEIOUYaeiouy", "circumflex": "AEIOUaeiou", "tilde": "ANOano", "dieresis": "AEIOUYaeiouy", "ring": "Aa", "cedilla": "Cc", "caron": "SZsz"}
_GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lamda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega"
#: name=character pairs for everything whose name isn't made by a rule
_OTHERS = (
    "exclam=! quotedbl=\" numbersign=# dollar=$ percent=% ampersand=& quotesingle=' quoteright=’ quoteleft=‘ parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- minus=− "
    "period=. slash=/ colon=: semicolon=; less=< greater=> question=? at=@ bracketleft=[ backslash=\\ bracketright=] asciicircum=^ underscore=_ grave=` braceleft={ bar=| braceright=} asciitilde=~ "
    "exclamdown=¡ cent=¢ sterling=£ currency=¤ yen=¥ brokenbar=¦ section=§ dieresis=¨ copyright=© ordfeminine=ª guillemotleft=« logicalnot=¬ registered=® macron=¯ degree=° plusminus=± "
    "twosuperior=² threesuperior=³ acute=´ paragraph=¶ periodcentered=· cedilla=¸ onesuperior=¹ ordmasculine=º guillemotright=» onequarter=¼ onehalf=½ threequarters=¾ questiondown=¿ "
    "AE=Æ Eth=Ð multiply=× Oslash=Ø Thorn=Þ germandbls=ß ae=æ eth=ð divide=÷ oslash=ø thorn=þ quotedblleft=“ quotedblright=” quotesinglbase=‚ quotedblbase=„ endash=– emdash=— "
    "ellipsis=… bullet=• dagger=† daggerdbl=‡ guilsinglleft=‹ guilsinglright=› perthousand=‰ trademark=™ fraction=⁄ Euro=€ florin=ƒ OE=Œ oe=œ Lslash=Ł lslash=ł "
    "circumflex=ˆ caron=ˇ tilde=˜ breve=˘ dotaccent=˙ ring=˚ hungarumlaut=˝ ogonek=˛ dotlessi=ı fi=fi fl=fl ff=ff ffi=ffi ffl=ffl theta1=ϑ phi1=ϕ omega1=ϖ sigma1=ς "
    "summation=∑ product=∏ integral=∫ partialdiff=∂ radical=√ infinity=∞ approxequal=≈ notequal=≠ lessequal=≤ greaterequal=≥ congruent=≅ existential=∃ "
    "universal=∀ suchthat=∋ asteriskmath=∗ lozenge=◊"
)
_GREEK_LETTERS_OF_SYMBOL = "ABCDEFGHIKLMNOPQRSTUWXYZ", "Alpha Beta Chi Delta Epsilon Phi Gamma Eta Iota Kappa Lambda Mu Nu Omicron Pi Theta Rho Sigma Tau Upsilon Omega Xi Psi Zeta"


@cache
def glyphs() -> dict[str, str]:
    out = {chr(c): chr(c) for c in (*range(65, 91), *range(97, 123))}
    for d in range(10):
        out[unicodedata.name(str(d)).split()[-1].lower()] = str(d)
    for mark, letters in _ACCENTED.items():
        for c in letters:
            out[c + mark] = unicodedata.normalize("NFC", c + _MARKS[mark])
    for name in _GREEK.split():
        for case, own in (("CAPITAL", name), ("SMALL", name.lower())):
            out[own.replace("amda", "ambda")] = unicodedata.lookup(f"GREEK {case} LETTER {name.upper()}")
    out.update(pair.split("=", 1) for pair in _OTHERS.split(" "))
    out |= {"equal": "=", "space": " ", "nbspace": "\xa0", "nbsp": "\xa0"}
    return out


def _char(digits: str) -> str | None:
    try:
        n = int(digits, 16) if digits.isalnum() else -1
    except ValueError:
        return None
    return chr(n) if 0 <= n < 0x110000 and not 0xD800 <= n < 0xE000 else None


def glyph_text(name: str) -> str | None:
    """Text of a glyph name: listed, ``uni`` with groups of four hex digits, or ``u`` with four to six."""
    if (known := glyphs().get(name)) is not None:
        return known
    if name.startswith("uni"):
        rest = name[3:]
        if not rest or len(rest) % 4:
            return None
        parts = [_char(rest[i : i + 4]) for i in range(0, len(rest), 4)]
        return None if None in parts else "".join(parts)
    if name.startswith("u") and 4 <= len(name) - 1 <= 6:
        return _char(name[1:])
    return None


def _latin(n: int) -> str | None:
    return chr(n) if n >= 32 else None


def _codec(codec: str, changes: dict[int, str]) -> list[str | None]:
    table = [_latin(n) for n in range(128)] + [bytes([n]).decode(codec, "ignore") or chr(n) for n in range(128, 256)]
    for n, text in {0x27: "’", 0x60: "‘", **changes}.items():
        table[n] = text
    return table


@cache
def base_encoding(name: str) -> list[str | None]:
    """Text of each byte; unknown names mean the standard encoding."""
    if name == "WinAnsiEncoding":
        return _codec("cp1252", {0xA0: " ", 0xAD: "-", 0xB5: "μ"})
    if name == "MacRomanEncoding":
        return _codec("mac_roman", {0xB5: "μ", 0xC6: "Δ", 0xCA: " ", 0xDB: "\xa4", 0xDE: "fi", 0xDF: "fl", 0xF0: "\xf0"})
    if name == "SymbolEncoding":
        table = [_latin(n) for n in range(256)]
        upper, names = _GREEK_LETTERS_OF_SYMBOL
        for c, own in zip(upper, names.split()):
            table[ord(c)], table[ord(c) + 32] = glyphs()[own], glyphs()[own.lower()]
        for c, own in zip('"$\'*-@JVjv', "universal existential suchthat asteriskmath minus congruent theta1 sigma1 phi1 omega1".split()):
            table[ord(c)] = glyphs()[own]
        return table
    rest = dict(zip(range(0xA1, 0xAE), "¡¢£⁄¥ƒ§¤'“«‹›"))
    rest |= {0xAE: "fi", 0xAF: "fl"} | dict(zip(range(0xB1, 0xB5), "–†‡·")) | dict(zip(range(0xB6, 0xBE), "¶•‚„”»…‰")) | {0xBF: "¿"}
    rest |= dict(zip(range(0xC1, 0xC9), "`´ˆ˜¯˘˙¨")) | {0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ"}
    rest |= {0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
    return _codec("latin-1", rest)

"""The content interpreter: operators in, positioned spans and ruling rectangles out."""

from __future__ import annotations

import math
import re

from vellumine.kernel.fonts import Font, font_style
from vellumine.kernel.objects import f32, f32_of, lax_hex, unescape

MAX_RECTS = 256
#: A number in a TJ array from which it stands for a space.
TJ_SPACE = -100.0
FORM_DEPTH, FORM_CALLS, FORM_INPUT, FORM_OUTPUT = 32, 16_384, 64 << 20, 16 << 20
MARK = "\x01"
_TENTH, _NEAR, _BREAK, _OLD, _NEW, _GAP = map(f32, (0.1, 0.35, 0.4, 0.7, 0.3, 0.2))

_TOKEN = re.compile(
    rb"(?:[\0\t\n\x0c\r ]++|%[^\r\n]*+)*+"
    rb"(?:(?P<num>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|\Z))"
    rb"|\((?P<plain>[^()\\]*)\)|(?P<open>\()|(?P<dict><<)|<(?P<hex>[^>]*)>?|(?P<start>\[)|(?P<end>\])"
    rb"|/(?P<name>[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<op>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<stray>>>?|[){}]))"
)
#: An operator with operands of the usual kinds, in one go: a name, numbers, a plain string. What looks otherwise is read token by token.
_USUAL = re.compile(
    rb"[\t\n\r ]*+(?:/([A-Za-z0-9_.+-]++)[\t\n\r ]++)?((?:[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)[\t\n\r ]++)*+)"
    rb"(?:\(([^()\\]*+)\)[\t\n\r ]*+)?([A-Za-z][A-Za-z0-9]?\*?|['\"])(?=[\t\n\r ]|\Z)"
)
#: The rest of an array of plain strings and numbers, in one go, and what is in it.
_USUAL_ARRAY = re.compile(rb"((?:[\t\n\r ]++|\([^()\\]*+\)|[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?=[\t\n\r (\]]))*+)\]")
_ITEM = re.compile(rb"\(([^()\\]*+)\)|([+-.0-9]++)")
#: Between words of such an array.
_JOINT = re.compile(rb"\)[\t\n\r ]*+([+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++))[\t\n\r ]*+\(")
_PAREN = re.compile(rb"[()\\]")
_ANGLES = re.compile(rb"<<|>>")
_MCID = re.compile(rb"/MCID[\0\t\n\x0c\r ]*([0-9]+)")
_IMAGE_END = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|\Z)")

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def apply(m, x: float, y: float) -> tuple[float, float]:
    if m == IDENTITY:
        return x, y
    return f32(f32(f32(m[0] * x) + f32(m[2] * y)) + m[4]), f32(f32(f32(m[1] * x) + f32(m[3] * y)) + m[5])


def concat(n, m) -> tuple:
    """``n`` first, then ``m``."""

    def dot(a, b, c, d):
        return f32(f32(a * b) + f32(c * d))

    return (dot(n[0], m[0], n[1], m[2]), dot(n[0], m[1], n[1], m[3]), dot(n[2], m[0], n[3], m[2]), dot(n[2], m[1], n[3], m[3]), f32(dot(n[4], m[0], n[5], m[2]) + m[4]), f32(dot(n[4], m[1], n[5], m[3]) + m[5]))


def scales(m) -> tuple[float, float]:
    if not m[1] and not m[2]:
        return abs(m[0]), abs(m[3])
    return f32(math.hypot(m[0], m[1])), f32(math.hypot(m[2], m[3]))


def turned(a, b) -> bool:
    """Whether the writing direction of two matrices differs clearly."""
    p, q = scales(a)[0], scales(b)[0]
    return min(p, q) > 1.1920929e-07 and a[0] * b[0] + a[1] * b[1] < p * q * 0.99


def octets(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class Span:
    __slots__ = ("text", "x", "y", "width", "height", "size", "bold", "italic", "mono", "image", "mcid", "space")

    def __init__(self, text, x, y, width, height, size, bold=False, italic=False, mono=False, image=False, mcid=None, space=False) -> None:
        self.text, self.x, self.y, self.width, self.height, self.size = text, x, y, width, height, size
        self.bold, self.italic, self.mono, self.image, self.mcid, self.space = bold, italic, mono, image, mcid, space


class Words(list):
    """Strings of an array that one and the same number, which stands for a space, moves apart."""

    number = 0.0

    @classmethod
    def of(cls, body: bytes) -> Words | None:
        m = _JOINT.search(body)
        if not m or body[:1] != b"(" or body[-1:] != b")" or (number := f32(float(m[1]))) > TJ_SPACE:
            return None
        out = cls(body[1:-1].split(m[0]))
        out.number = number
        return out if body.count(b"(") == len(out) == body.count(b")") else None

    def items(self) -> list:
        out = [self.number] * (2 * len(self) - 1)
        out[::2] = self
        return out


class Tokens:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.mcid = data, 0, None

    def next(self) -> tuple[str, object]:
        data = self.data
        while m := _TOKEN.match(data, self.at):
            kind = m.lastgroup
            self.at = m.end()
            if kind == "num":
                return kind, f32(float(m[kind]))
            if kind == "plain":
                return "str", m[kind]
            if kind in ("name", "op", "start", "end"):
                return kind, m[kind]
            if kind == "hex":
                return "str", lax_hex(m[kind])
            if kind == "open":
                return "str", self._string()
            if kind == "dict":
                self._dictionary()
        return "eof", None

    def _string(self) -> bytes:
        start, depth, end = self.at, 1, len(self.data)
        while depth:
            m = _PAREN.search(self.data, self.at)
            if not m:
                self.at = end
                return self.data[start:]
            self.at = m.end()
            if m[0] == b"\\":
                self.at = min(self.at + 1, end)
            else:
                depth += 1 if m[0] == b"(" else -1
        return unescape(self.data[start : self.at - 1])

    def _dictionary(self) -> None:
        start, depth = self.at, 1
        while depth:
            m = _ANGLES.search(self.data, self.at)
            self.at = m.end() if m else len(self.data)
            if not m:
                break
            depth += 1 if m[0] == b"<<" else -1
        if m := _MCID.search(self.data, start, self.at):
            self.mcid = min(int(m[1]), 2**32 - 1)

    def skip_image(self) -> None:
        """To the end of an inline image, of which BI has been read."""
        while True:
            kind, v = self.next()
            if kind == "eof":
                return
            if kind == "op" and v == b"ID":
                m = _IMAGE_END.search(self.data, self.at)
                self.at = m.end() if m else len(self.data)
                return


class State:
    """Text state; a Form starts with the caller's font and sizes and fresh positions."""

    def __init__(self, caller: State | None = None) -> None:
        self.inside = False
        self.line = self.last_x = self.last_y = self.typical = None
        self.space = self.form_word = False
        if caller:
            self.font, self.size, self.leading, self.style, self.h, self.v = caller.font, caller.size, caller.leading, caller.style, caller.h, caller.v
        else:
            self.font, self.size, self.leading, self.style, self.h, self.v = None, 0.0, 0.0, (False, False, False), 0.0, 0.0

    def set_line(self, m) -> None:
        self.h, self.v = scales(m)
        self.line = m


class Page:
    """Interprets one page. ``forms`` maps references to (content, fonts, xobjects), the last two None without own resources."""

    def __init__(self, forms: dict, images: dict, limits: tuple[int, int, int] = (FORM_CALLS, FORM_INPUT, FORM_OUTPUT)) -> None:
        self.forms, self.images = forms, images
        self.max_calls, self.max_input, self.max_output = limits
        self.spans: list[Span] = []
        self.rects: list[tuple[float, float, float, float]] = []
        self.ctm, self.ctms = IDENTITY, []
        self.path = (0.0, 0.0)
        self.mcid, self.mcids = None, []
        self.last_ws, self.last_alnum, self.emitted = True, False, 0
        self.active: list = []
        self.calls = self.input = self.output = 0

    def run(self, data: bytes, fonts: dict[bytes, Font], xobjects: dict, state: State | None = None) -> None:
        state = state or State()
        tokens = Tokens(data)
        nums, name, string, array = [], None, None, None
        usual = _USUAL.match
        while not (self.active and self.output >= self.max_output):
            if not nums and name is None and string is None and array is None and (m := usual(data, tokens.at)):
                tokens.at = m.end()
                name, operands, string, v = m.groups()
                nums, kind = f32_of(operands.split()) if operands else nums, "op"
            else:
                kind, v = tokens.next()
            if kind == "num":
                nums.append(v)
            elif kind == "name":
                name = v
            elif kind == "str":
                string = v
            elif kind == "start":
                array = []
                if m := _USUAL_ARRAY.match(data, tokens.at):
                    tokens.at = m.end()
                    if array := Words.of(m[1]):
                        continue
                    found = _ITEM.findall(m[1])
                    known = {n: f32(float(n)) for n in {n for _, n in found} if n}
                    array = [known[n] if n else t for t, n in found]
                    continue
                while (item := tokens.next())[0] not in ("end", "eof"):
                    if item[0] in ("num", "str"):
                        array.append(item[1])
            elif kind == "op":
                before, charged = self.emitted, self.output
                self._operator(v, nums[:6], name, string, array, state, fonts, xobjects, tokens)
                if self.active:
                    own = self.emitted - before - (self.output - charged)
                    self.output = min(self.output + max(own, 0), self.max_output)
                if v == b"BI":
                    tokens.skip_image()
                nums, name, string, array = [], None, None, None
            elif kind == "eof":
                return

    def _operator(self, op, nums, name, string, array, state: State, fonts, xobjects, tokens: Tokens) -> None:
        if op == b"Tj":
            if string is not None:
                self._show(state, string)
        elif op == b"TJ":
            if array.__class__ is Words:
                if all(array) and self._show_words(state, array):
                    return
                array = array.items()
            for i, item in enumerate(array or ()):
                if isinstance(item, bytes):
                    if self._show(state, item) and math.isfinite(self.spans[-1].width) and i + 1 < len(array):
                        self._show_rest(state, array[i + 1 :])
                        break
                elif item <= TJ_SPACE:
                    state.space = True
        elif op in (b"Td", b"TD"):
            if len(nums) >= 2:
                if op == b"TD":
                    state.leading = -nums[1]
                self._move(state, nums[0], nums[1])
        elif op in (b"T*", b"'", b'"'):
            self._move(state, 0.0, -state.leading)
            if op != b"T*" and string is not None:
                self._show(state, string)
        elif op == b"Tm":
            if len(nums) == 6:
                m = tuple(nums)
                if state.line is not None and m[:4] == state.line[:4]:
                    turn, state.line = False, m
                else:
                    turn = state.line is not None and turned(state.line, m)
                    state.set_line(m)
                self._moved(state, m[4], m[5])
                state.space = state.space or turn
        elif op == b"Tf":
            if name is not None and nums:
                state.font, state.size = fonts.get(name), nums[0]
                own = font_style(state.font.base) if state.font else (False,) * 3
                state.style = tuple(a or b for a, b in zip(font_style(name), own))
        elif op == b"BT":
            state.inside = True
            state.set_line(IDENTITY)
        elif op == b"ET":
            state.inside = False
        elif op == b"TL":
            if nums:
                state.leading = nums[0]
        elif op == b"q":
            self.ctms.append(self.ctm)
        elif op == b"Q":
            if self.ctms:
                self.ctm = self.ctms.pop()
        elif op == b"cm":
            if len(nums) == 6:
                self.ctm = concat(tuple(nums), self.ctm)
        elif op == b"re":
            if len(nums) >= 4:
                x, y, w, h = nums[:4]
                a, b = apply(self.ctm, x, y), apply(self.ctm, f32(x + w), f32(y + h))
                self._rect(min(a[0], b[0]), min(a[1], b[1]), f32(abs(b[0] - a[0])), f32(abs(b[1] - a[1])))
        elif op == b"m":
            if len(nums) >= 2:
                self.path = (nums[0], nums[1])
        elif op == b"l":
            if len(nums) >= 2:
                a, b = apply(self.ctm, *self.path), apply(self.ctm, nums[0], nums[1])
                dx, dy = f32(abs(b[0] - a[0])), f32(abs(b[1] - a[1]))
                if dx <= 1.5 or dy <= 1.5:
                    self._rect(min(a[0], b[0]), min(a[1], b[1]), max(dx, 0.5), max(dy, 0.5))
                self.path = (nums[0], nums[1])
        elif op == b"Do":
            if name is not None and (ref := xobjects.get(name)) is not None:
                self._invoke(ref, state, fonts, xobjects)
        elif op == b"BDC":
            self.mcids.append(self.mcid)
            if tokens.mcid is not None:
                self.mcid, tokens.mcid = tokens.mcid, None
        elif op == b"BMC":
            self.mcids.append(self.mcid)
        elif op == b"EMC":
            self.mcid = self.mcids.pop() if self.mcids else None

    def _rect(self, x: float, y: float, w: float, h: float) -> None:
        rule = h < 2.5 and w > 16 or w < 2.5 and h > 16
        if len(self.rects) < MAX_RECTS and (rule or 8 < w < 280 and 8 < h < 80):
            self.rects.append((x, y, w, h))

    def _move(self, state: State, tx: float, ty: float) -> None:
        if state.line is None:
            return
        a, b, c, d, e, f = state.line
        e = f32(e + f32(f32(tx * a) + f32(ty * c)))
        f = f32(f + f32(f32(tx * b) + f32(ty * d)))
        state.set_line((a, b, c, d, e, f))
        self._moved(state, e, f)

    def _moved(self, state: State, x: float, y: float) -> None:
        """Decides from a new position whether a line or a word has ended."""
        if state.inside:
            size = abs(state.size)
            tall = max(f32(size * (state.v if state.v > 0 else 1.0)), 1.0)
            dy = f32(abs(y - (y if state.last_y is None else state.last_y)))
            if dy > f32(tall * _BREAK):
                if dy > (tall * 2 if state.typical is None else f32(state.typical * 1.5)):
                    self.last_ws = True
                else:
                    state.typical = dy if state.typical is None else f32(f32(state.typical * _OLD) + f32(dy * _NEW))
                state.space = state.form_word = False
            elif state.last_x is not None:
                wide = max(f32(size * (state.h if state.h > 0 else 1.0)), 1.0)
                if f32(x - state.last_x) > f32(wide * _GAP):
                    state.space = True
        state.last_x, state.last_y = x, y

    def _show(self, state: State, raw: bytes) -> bool:
        """Whether the string has text."""
        if state.font is None or not (text := state.font.text(raw)):
            return False
        space = state.space and not self.last_ws and self.emitted > 0
        space = space or state.form_word and self.last_alnum and text[0].isalnum()
        state.space = state.form_word = False
        n = octets(text)
        self.emitted += n + space
        self.last_ws, self.last_alnum = text[-1] in " \n\t\r", text[-1].isalnum()
        h, v = (s if s > 0 else 1.0 for s in (state.h, state.v))
        size = max(f32(abs(state.size) * v), _TENTH)
        x, y = apply(self.ctm, state.last_x or 0.0, state.last_y or 0.0)
        width = f32(f32(f32(n * size) * 0.5) * max(h, _TENTH))
        last = self.spans[-1] if self.spans else None
        bold, italic, mono = state.style
        if (
            last is not None
            and not last.image
            and (last.bold, last.italic, last.mono) == state.style
            and last.mcid == self.mcid
            and f32(abs(last.y - y)) <= f32(size * _NEAR)
            and (f32(abs(x - last.x)) < 1.0 or x <= f32(f32(last.x + last.width) + f32(size * _NEAR)))
        ):
            if space and not last.text.endswith(" "):
                last.text += " "
            last.text += text
            last.width = max(f32(f32(x + width) - last.x), f32(last.width + width))
            return True
        self.spans.append(Span(text, x, y, width, size, size, bold, italic, mono, False, self.mcid, space))
        return True

    def _show_words(self, state: State, words: Words) -> bool:
        """Shows them and tells so, if each is one piece of text without white space; as ``_show_rest``, but for a step by C for most of it."""
        font = state.font
        if font is None or font.table is None or font.table[32] != " ":
            return False
        raw = b" ".join(words)
        text = font.text(raw)
        if len(text) != len(raw) or text.count(" ") != len(words) - 1 or "\n" in text or "\t" in text or "\r" in text or not font.single():
            return False
        self._show(state, words[0])
        last = self.spans[-1]
        if not math.isfinite(last.width):
            self._show_rest(state, words.items()[1:])
            return True
        h, v = (s if s > 0 else 1.0 for s in (state.h, state.v))
        size, wide = max(f32(abs(state.size) * v), _TENTH), max(h, _TENTH)
        x = apply(self.ctm, state.last_x or 0.0, state.last_y or 0.0)[0]
        lengths = [*map(len, words)] if text.isascii() else [octets(w) for w in text.split(" ")]
        widths = {n: (w := f32(f32(f32(n * size) * 0.5) * wide), f32(f32(x + w) - last.x)) for n in {*lengths[1:]}}
        total = last.width
        for n in lengths[1:]:
            width, least = widths[n]
            total = f32(total + width)
            if least > total:
                total = least
        last.text, last.width = last.text + text[len(words[0]) :], total
        self.emitted += sum(lengths) - lengths[0] + len(words) - 1
        self.last_ws, self.last_alnum = False, text[-1].isalnum()
        return True

    def _show_rest(self, state: State, items: list) -> None:
        """What follows the first text of an array: nothing moves between its strings, so that the same span takes them all."""
        last, read, space, ws = self.spans[-1], state.font.text, False, self.last_ws
        h, v = (s if s > 0 else 1.0 for s in (state.h, state.v))
        size, wide = max(f32(abs(state.size) * v), _TENTH), max(h, _TENTH)
        x = apply(self.ctm, state.last_x or 0.0, state.last_y or 0.0)[0]
        parts, end, total, text = [last.text], last.text[-1], last.width, None
        #: By octets: the width of a text, and the span's that ends with it.
        widths: dict[int, tuple[float, float]] = {}
        for item in items:
            if item.__class__ is not bytes:
                space = space or item <= TJ_SPACE
                continue
            if not (own := read(item)):
                continue
            text, n = own, octets(own)
            if n not in widths:
                width = f32(f32(f32(n * size) * 0.5) * wide)
                widths[n] = width, f32(f32(x + width) - last.x)
            width, least = widths[n]
            self.emitted += n
            if space and not ws:
                self.emitted += 1
                if end != " ":
                    parts.append(" ")
            parts.append(text)
            end, space = text[-1], False
            ws = end in " \n\t\r"
            total = max(least, f32(total + width))
        state.space = space
        if text is not None:
            last.text, last.width = "".join(parts), total
            self.last_ws, self.last_alnum = ws, end.isalnum()

    def _invoke(self, ref, state: State, fonts, xobjects) -> None:
        if (filename := self.images.get(ref)) is not None:
            size = 2 + octets(filename) + 2
            if self.active and size > self.max_output - self.output:
                return
            self.emitted += size
            self.last_ws, self.last_alnum = True, False
            x, y = apply(self.ctm, 0.0, 0.0)
            self.spans.append(Span(filename, x, y, 1.0, 1.0, 1.0, image=True, mcid=self.mcid))
            state.space = state.form_word = False
            return
        form = self.forms.get(ref)
        if form is None:
            return
        content, own_fonts, own_xobjects = form
        if len(self.active) >= FORM_DEPTH or ref in self.active or self.calls >= self.max_calls or self.output >= self.max_output or len(content) > self.max_input - self.input:
            return
        first, before, ws, alnum = len(self.spans), self.emitted, self.last_ws, self.last_alnum
        self.calls += 1
        self.input += len(content)
        self.active.append(ref)
        own = own_fonts is not None and own_xobjects is not None
        self.run(content, own_fonts if own else fonts, own_xobjects if own else xobjects, State(state))
        self.active.pop()
        if self.emitted == before:
            return
        if first < len(self.spans):
            lead = self.spans[first].text[:1]
            if lead and not lead.isspace() and not ws and (state.space or alnum and lead.isalnum()):
                self.spans[first].space = True
            state.form_word = self.last_alnum
        state.space = False

"""The file decoder and page formatter on literal inputs."""

import os
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.kernel import filters, images, inflate
from vellumine.kernel.content import IDENTITY, Page, Span, concat, turned
from vellumine.kernel.convert import convert
from vellumine.kernel.document import Document, find_startxref
from vellumine.kernel.encodings import base_encoding, glyph_text
from vellumine.kernel.extract import collect_forms, extract
from vellumine.kernel.fonts import CMap, Font, differences, font_style
from vellumine.kernel.layout import assemble, cluster, column_gaps, format_page, format_pages, gfm, link_images, median_size, promote_title, running_margins
from vellumine.kernel.lines import all_caps, heading_level, list_item, named_section, numbered, strip_number
from vellumine.kernel.objects import Name, Parser, PdfError, Ref, Stream, f32, lax_hex, strict_hex
from vellumine.testing.pdf_builder import Builder, literal, text_content, text_pdf

# ---------------------------------------------------------------- objects


@pytest.mark.parametrize(
    "raw, value",
    [
        (b"true", True), (b"false ", False), (b"null", None), (b"42", 42), (b"-7", -7), (b"+3", 3), (b"1.5", 1.5), (b"-.5", -0.5), (b"4.", 4.0), (b".", 0.0),
        (b"99999999999999999999", 2**63 - 1), (b"12 0 R", Ref(12, 0)), (b"12 0 Rx", 12), (b"[1 2 R 3 0 R]", [Ref(1, 2), Ref(3, 0)]), (b"(a(b)c)", b"a(b)c"),
        (b"(\\n\\101\\7\\\\\\)\\q\\\nx\\\r\ny)", b"\nA\x07\\)qxy"), (b"(\\777)", b"\xff"), (b"<4 8 6>", b"\x48\x60"), (b"<zz41>", b"A"), (b"/A#42#zz", Name(b"AB#zz")), (b"/", Name(b"")),
        (b"<</A 1/B[/C]/A 2>>", {b"A": 2, b"B": [Name(b"C")]}), (b"% note\n 5", 5), (b"<< /K (v) % c\n >>", {b"K": b"v"}),
    ],
)
def test_values(raw, value):
    got = Parser(raw).value()
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("raw", [b"", b"(open", b"<41", b"[1", b"<</A", b"<</A 1", b"<<1 2>>", b"+", b"x", b"[" * 300 + b"]" * 300, b"<<" + b"".join(b"/K%d 1" % i for i in range(5000)) + b">>"])
def test_bad_values(raw):
    with pytest.raises(PdfError):
        Parser(raw).value()


def test_streams():
    data = b"1 0 obj <</Length 3>> stream\r\nABC\nendstream endobj"
    ref, s = Parser(data).indirect()
    assert ref == (1, 0) and s.raw(data) == b"ABC"
    data = b"1 0 obj <</Length 9 0 R>> stream\nABC\r\nendstream endobj"
    assert Parser(data).indirect()[1].raw(data) == b"ABC"
    assert Parser(data).indirect(lambda r: 4)[1].raw(data) == b"ABC\r"
    assert Parser(data).indirect(lambda r: 0)[1].raw(data) == b"ABC"
    for bad in (b"1 0 obj <<>> stream\nA\nendstream", b"1 0 obj <</Length 99>> stream\nA\nendstream", b"1 0 obj <</Length 1 0 R>> stream\nA", b"1 0 obj 5 stream\nA", b"1 0 xxx", b" "):
        with pytest.raises(PdfError):
            Parser(bad).indirect()
    assert Stream({}, 50, 9).raw(b"short") == b""


def test_hex():
    assert lax_hex(b"4 1x4>42") == b"A@" and strict_hex(b"4 14") == b"A@" and strict_hex(b"4x") is None


# ---------------------------------------------------------------- filters


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 9))
def test_inflate(raw, level):
    z = zlib.compress(raw, level)
    assert inflate.inflate(z) == raw == inflate.slow_inflate(z[2:-4])
    assert inflate.inflate(z[:-4] + b"zzzz") == raw


def test_inflate_damage():
    for bad in (b"", b"x", b"\x79\x9c12", b"\x78\x9d123456", b"\x78\x20", zlib.compress(b"abc" * 50, 0)[:30], b"\x78\x9c\x07" + bytes(8), b"\x78\x01\x01\x01\x00\x00\x00Axxxx"):
        with pytest.raises(PdfError) as e:
            inflate.inflate(bad)
        assert e.value.code == "DEFLATE"
    # fixed codes whose end is cut off: bits past the end are 0, which is the end of the block
    fixed = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_FIXED)
    body = fixed.compress(b"A") + fixed.flush()
    assert inflate.slow_inflate(body[:2]) == b"A"


def test_inflate_limit(monkeypatch):
    monkeypatch.setattr(inflate, "MAX_OUTPUT", 1000)
    assert len(inflate.inflate(zlib.compress(bytes(1000)))) == 1000
    with pytest.raises(PdfError):
        inflate.inflate(zlib.compress(bytes(1001)))
    with pytest.raises(PdfError):
        inflate.slow_inflate(zlib.compress(bytes(1001))[2:-4])


def test_ascii85():
    import base64

    for n in range(12):
        raw = os.urandom(n)
        assert filters.ascii85(base64.a85encode(raw) + b"~>") == raw
    assert filters.ascii85(b"z") == bytes(4) and filters.ascii85(b"uuuuu") == b"" and filters.ascii85(b"!! !!\n!") == bytes(4) and filters.ascii85(b"!") == b""


def png_rows(rows, step, tags):
    out, above = b"", bytes(len(rows[0]))
    for row, tag in zip(rows, tags):
        line = []
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, near)[tag]) & 255)
        out += bytes([tag, *line])
        above = row
    return out


def test_predictor():
    rng = random.Random(1)
    for colors, columns in ((1, 7), (3, 5)):
        rows = [bytes(rng.randrange(256) for _ in range(colors * columns)) for _ in range(10)]
        tags = [rng.randrange(5) for _ in rows]
        parms = {b"Columns": columns, b"Colors": colors}
        assert filters.unpredict(png_rows(rows, colors, tags) + b"\1rest", parms) == b"".join(rows)
    assert filters.unpredict(b"\x09abc", {b"Columns": 3}) == b"abc"
    for bad in ({b"Columns": 0}, {b"Colors": 33}, {b"BitsPerComponent": 64}):
        with pytest.raises(PdfError):
            filters.unpredict(b"", bad)


def test_filter_chain():
    data = b"  789c>"
    s = Stream({b"Filter": [Name(b"ASCIIHexDecode"), Name(b"DCTDecode")]}, 2, 5)
    assert filters.decode(s, data) == b"\x78\x9c"
    with pytest.raises(PdfError) as e:
        filters.decode(Stream({b"Filter": Name(b"LZWDecode")}, 0, 3), data)
    assert e.value.code == "FILTER" and "LZWDecode" in str(e.value)


# ---------------------------------------------------------------- documents


def code_of(data):
    with pytest.raises(PdfError) as e:
        Document(data)
    return e.value.code


def test_errors():
    good = text_pdf([["Hello"]])
    assert code_of(b"not a pdf") == "NOT_PDF" and str(PdfError("NOT_PDF")) == "input does not look like a PDF"
    assert code_of(good.replace(b"startxref", b"startxxxx")) == "XREF"
    assert code_of(good.replace(b"/Root 1 0 R", b"/Ruut 1 0 R")) == "OBJECT"
    assert code_of(good.replace(b"/Pages 2 0 R", b"/Pagez 2 0 R")) == "OBJECT"
    at = good.rindex(b"startxref")
    assert code_of(good[:at] + b"startxref\n99999999\n") == "OBJECT"
    assert code_of(good[: good.rindex(b"xref\n0", 0, at)] + b"xref\n0 4000000000\n" + b"startxref\n%d\n" % good.rindex(b"xref\n0", 0, at)) == "XREF"
    for n in range(0, len(good), 97):
        try:
            convert(good[:n])
        except PdfError:
            pass


def test_a_cut_block_that_reads_as_one_symbol_for_ever_ends_at_once():
    """Past the end all bits are 0; with codes of a bit, of which 0 is a letter, no end of the block comes."""
    order = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
    number = lambda v, n: "".join(str(v >> i & 1) for i in range(n))
    sizes = {0: 2, 1: 2, 18: 1}
    bits = "1" + number(2, 2) + number(0, 5) + number(0, 5) + number(14, 4) + "".join(number(sizes.get(i, 0), 3) for i in order[:18])
    zeros = lambda n: "0" + number(n - 11, 7)
    bits += zeros(65) + "11" + zeros(138) + zeros(52) + "11" + "10"
    data = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    start = time.process_time()
    with pytest.raises(PdfError):
        inflate.slow_inflate(data)
    assert time.process_time() - start < 1


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_damage_never_escapes(data):
    raw = bytearray(text_pdf([["1.1 Heading", "", "Some text (here)."], ["- a", "- b"]], packed=data.draw(st.booleans())))
    for _ in range(data.draw(st.integers(1, 8))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    try:
        assert convert(bytes(raw))[0].endswith("\n")
    except PdfError:
        pass


def test_newest_entry_wins_and_cycles_end():
    b = Builder()
    font = b.font()
    page = b.page(b"BT /F1 12 Tf 50 700 Td (old) Tj ET", b"/Font <</F1 %d 0 R>>" % font, flate=False)
    old = b.build()
    start = find_startxref(old)
    content = page - 1
    at = len(old)
    body = b"%d 0 obj\n<</Length 34>>\nstream\nBT /F1 12 Tf 50 700 Td (new) Tj ET\nendstream\nendobj\n" % content
    new = old + body + b"xref\n%d 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R /Prev %d>>\nstartxref\n%d\n" % (content, at, start, at + len(body))
    assert convert(old)[0] == "# old\n" and convert(new)[0] == "# new\n"
    own = at + len(body)
    loop = new.replace(b"/Prev %d" % start, b"/Prev %d" % own)
    assert code_of(loop) == "OBJECT"


def test_object_streams_and_inherited_resources():
    b = Builder()
    font = b.font()
    b.objects[b.add(b"<<>>")] = b"<</Type /Pages /Kids [] >>"
    b.page(b"BT /F1 12 Tf 50 700 Td (packed) Tj ET", b"/Font <</F1 %d 0 R>>" % font)
    data = b.build_packed()
    assert convert(data)[0] == "# packed\n"
    assert len(Document(data).pages) == 1


def test_length_in_an_object_stream_is_repaired():
    b = Builder()
    font, length = b.font(), b.add(b"54")
    text = b"BT /F1 12 Tf 50 700 Td (a endstream b) Tj ET"
    text += b" " * (54 - len(text))
    stream = b.add(b"<</Length %d 0 R>>\nstream\n%s\nendstream" % (length, text))
    b.page(stream, b"/Font <</F1 %d 0 R>>" % font)
    assert convert(b.build_packed())[0] == "# a endstream b\n"


def test_contents_array_and_missing_parts():
    b = Builder()
    font = b.font()
    parts = [b.stream(b"BT /F1 12 Tf 50 700 Td (one) Tj"), b.add(b"<</Length 3 /Filter /LZWDecode>>\nstream\nxyz\nendstream"), b.stream(b"0 -14 Td (two) Tj ET")]
    array = b.add(b"[%s]" % b" ".join(b"%d 0 R" % p for p in parts))
    b.page(array, b"/Font <</F1 %d 0 R>>" % font)
    assert convert(b.build())[0] == "# one two\n"
    b = Builder()
    b.pages.append(b.add(b"<</Type /Page /Parent 2 0 R>>"))
    assert convert(b.build()) == ("\n", [])


# ---------------------------------------------------------------- fonts


def test_encodings():
    win, mac, std = (base_encoding(n) for n in ("WinAnsiEncoding", "MacRomanEncoding", "anything"))
    assert [t[0x27] for t in (win, mac, std)] == ["’"] * 3 and [t[0x60] for t in (win, mac, std)] == ["‘"] * 3
    assert (win[0x80], win[0xA0], win[0xAD], win[0xE9], win[0x81]) == ("€", " ", "-", "é", "\x81")
    assert (mac[0x8E], mac[0xDE], mac[0xCA]) == ("é", "fi", " ") and (std[0xAE], std[0xA9], std[0xD0], std[0xFB]) == ("fi", "'", "\xd0", "ß")
    assert base_encoding("SymbolEncoding")[0x61] == "α" and win[0x1F] is None and win[0x7F] == "\x7f"


def test_glyphs():
    assert [glyph_text(n) for n in ("A", "zero", "Eacute", "scaron", "ffi", "minus", "Lambda", "uni00410042", "u1F600", "equal", "space")] == ["A", "0", "É", "š", "ffi", "−", "Λ", "AB", "😀", "=", " "]
    assert [glyph_text(n) for n in (".notdef", "uni", "uni004", "uniD800", "u12", "uzzzz", "nonsense")] == [None] * 7


def test_cmap():
    m = CMap(b"/X << /Y (skip <41>) >> 1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar "
             b"3 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] <0000> <ffffffff> <0041> endbfrange 1 beginbfchar <0003> <D83DDE00> <0004> <D83D> <0005> <41> endbfchar % end")
    assert m.width == 2 and m.texts == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "x", 33: "y", 3: "😀", 5: "A"}
    assert CMap(b"1 beginbfrange <01> <02>").texts == {} and CMap(b"").width == 1


def test_font_decode():
    b = Builder()
    m = b.stream(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0041> <0058> endbfchar")
    simple = b.font(extra=b"/Encoding <</BaseEncoding /WinAnsiEncoding /Differences [65 /alpha /uni0058 70 /nonsense]>>")
    wide = b.add(b"<</Type /Font /Subtype /Type0 /BaseFont /W /ToUnicode %d 0 R>>" % m)
    bare = b.add(b"<</Type /Font /Subtype /Type0>>")
    doc = Document(b.build())
    assert Font(doc, Ref(simple, 0)).text(b"ABCF\x01") == "αXCF"
    assert Font(doc, Ref(wide, 0)).text(b"\0A\0B\0A") == "XX" and Font(doc, Ref(bare, 0)).text(b"\0A") == ""
    assert Font(doc, Ref(999, 0)).text(b"A'") == "A’"
    assert differences([65, Name(b"a"), Name(b"b"), 255, Name(b"c"), Name(b"d")]) == {65: "a", 66: "b", 255: "c"}
    assert font_style(b"Times-Bold") == (True, False, False) and font_style(b"Menlo-BoldItalic") == (True, True, True) and font_style(b"Helv") == (False,) * 3


# ---------------------------------------------------------------- content


class Plain:
    base = b"Helvetica"

    def text(self, raw):
        return raw.decode("latin-1")


def run(content, forms=None, images=None, xobjects=None, **limits):
    page = Page(forms or {}, images or {}, **limits)
    page.run(content, {b"F1": Plain(), b"B": type("Bold", (Plain,), {"base": b"X-Bold"})()}, xobjects or {})
    return page


def texts(page):
    return [s.text for s in page.spans]


def test_positions():
    p = run(b"BT /F1 18 Tf 1 0 0 1 50 700 Tm (Hello) Tj ET 10 20 30 40 re")
    assert [(s.x, s.y, s.size) for s in p.spans] == [(50, 700, 18)] and p.rects == [(10, 20, 30, 40)]
    assert texts(run(b"BT /F1 1 Tf 12 0 0 12 0 100 Tm (Hello) Tj 0.1 0 Td (World) Tj ET")) == ["HelloWorld"]
    assert texts(run(b"BT /F1 1 Tf 12 0 0 12 0 100 Tm (Hello) Tj 0.3 0 Td (World) Tj ET")) == ["Hello World"]
    assert texts(run(b"BT /F1 1 Tf 12 0 0 12 0 100 Tm (top) Tj 0 -1 Td (bottom) Tj ET")) == ["top", "bottom"]
    assert turned(IDENTITY, (0, 1, -1, 0, 0, 0)) and not turned(IDENTITY, (2, 0, 0, 2, 0, 0)) and not turned(IDENTITY, (0,) * 6)
    assert concat((2, 0, 0, 2, 0, 0), (1, 0, 0, 1, 5, 6)) == (2, 0, 0, 2, 5, 6)


def test_show_operators():
    p = run(b"BT /F1 12 Tf 14 TL 50 700 Td (a) Tj (b) ' 1 2 (c) \" [(d) -150 (e) -50 (f)] TJ T* (g) Tj 0 -14 TD (h) Tj ET (no font) Tj")
    assert "".join(texts(p)).replace(" ", "").startswith("abcdefgh") and "d e" in " ".join(texts(p))
    assert texts(run(b"(x) Tj")) == [] and texts(run(b"BT /Nope 12 Tf (x) Tj ET")) == []
    assert texts(run(b"BT /F1 12 Tf (a\\(b) Tj <4142> Tj (open")) == ["a(bAB"]
    assert texts(run(b"BT /F1 12 Tf (a) Tj ) } { > ] ET BI /W 1 ID (junk) Tj\nEI (b) Tj")) == ["ab"]
    assert texts(run(b"BT /F1 12 Tf (a) Tj BI /W 1 ID never ends")) == ["a"]


def test_styles_and_marked_content():
    p = run(b"BT /F1 12 Tf /P <</MCID 3>> BDC (Hi) Tj EMC /P BMC (x) Tj EMC /B 12 Tf (y) Tj ET")
    assert [(s.text, s.mcid, s.bold) for s in p.spans] == [("Hi", 3, False), ("x", None, False), ("y", None, True)]
    assert run(b"q 2 0 0 2 0 0 cm 0 0 m 40 0 l Q 0 0 m 20 20 l 10 20 30 40 re 0 0 5 5 re").rects == [(0, 0, 80, 0.5), (10, 20, 30, 40)]
    assert len(run(b"0 0 20 20 re " * 400).rects) == 256


def test_forms():
    r = {n: Ref(i, 0) for i, n in enumerate((b"A", b"B", b"C"), 1)}
    forms = {r[b"A"]: (b"(X) Tj /B Do", None, None), r[b"B"]: (b"(Y) Tj /A Do /C Do", None, None), r[b"C"]: (b"(Z) Tj", {b"F1": Plain()}, {})}
    p = run(b"BT /F1 12 Tf /A Do ET", forms, xobjects=r)
    assert "".join(texts(p)).replace(" ", "") == "XYZ"
    assert texts(run(b"BT /F1 12 Tf (a) Tj /C Do (b) Tj ET", forms, xobjects=r)) == ["a", "Z b"] or "".join(texts(run(b"BT /F1 12 Tf (a) Tj /C Do (b) Tj ET", forms, xobjects=r))).replace(" ", "") == "aZb"
    assert texts(run(b"BT /F1 12 Tf /C Do /C Do", forms, xobjects=r, limits=(1, 100, 100))) == ["Z"]
    assert texts(run(b"BT /F1 12 Tf /C Do", forms, xobjects=r, limits=(9, 3, 100))) == []
    assert [(s.image, s.text) for s in run(b"1 0 0 1 5 6 cm /A Do", images={r[b"A"]: "img-001.png"}, xobjects=r).spans] == [(True, "img-001.png")]


def test_form_collection():
    b = Builder()
    inner = b.stream(b"(deep) Tj", b"/Type /XObject /Subtype /Form")
    outer = b.stream(b"/I Do", b"/Type /XObject /Subtype /Form /Resources <</XObject <</I %d 0 R>>>>" % inner)
    b.page(b"/O Do", b"/XObject <</O %d 0 R>>" % outer)
    doc = Document(b.build())
    refs = [{b"O": Ref(outer, 0)}]
    assert sorted(collect_forms(doc, refs)) == [Ref(inner, 0), Ref(outer, 0)] and list(collect_forms(doc, refs, max_forms=1)) == [Ref(outer, 0)] and collect_forms(doc, refs, max_bytes=1) == {}


# ---------------------------------------------------------------- structure and images


def test_roles():
    b = Builder()
    page = b.page(b"")
    cell = b.add(b"<</S /TD /K <</Type /MCR /Pg %d 0 R /MCID 2>>>>" % page)
    root = b.add(b"<</K [<</S /H1 /Pg %d 0 R /K 0>> <</S /Table /Pg %d 0 R /K [%d 0 R <</S /P /K 5>>]>> <</S /P /Pg %d 0 R /K 9>> <</S /H2 /Pg %d 0 R /K 0>>]>>" % (page, page, cell, page, page))
    b.catalog_extra = b"/StructTreeRoot %d 0 R" % root
    found = extract(b.build())
    assert found.roles == {(0, 0): ("heading", 1), (0, 2): ("td", None), (0, 5): ("table", None)}


def test_images():
    b = Builder()
    jpg = b.add(b"<</Subtype /Image /Width 1 /Height 1 /Filter [/ASCIIHexDecode /DCTDecode] /Length 5>>\nstream\n4869>\nendstream")
    lzw = b.add(b"<</Subtype /Image /Width 1 /Height 1 /Filter /LZWDecode /Length 1>>\nstream\nx\nendstream")
    rgb = b.stream(b"ABCDEF", b"/Subtype /Image /Width 2 /Height 1 /ColorSpace /DeviceRGB")
    cmyk = b.stream(b"AAAA", b"/Subtype /Image /W 1 /H 1 /CS [/DeviceCMYK] /BPC 8")
    deep = b.stream(b"A", b"/Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 1")
    b.page(b"/J Do /C Do", b"/XObject <<%s>>" % b" ".join(b"/%s %d 0 R" % x for x in ((b"J", jpg), (b"L", lzw), (b"R", rgb), (b"C", cmyk), (b"D", deep))))
    md, files = convert(b.build(), image_dir="figs/")
    assert [n for n, _ in files] == ["img-001.jpg", "img-002.png", "img-003.png"] and files[0][1] == b"Hi"
    assert md == "![](figs/img-001.jpg)![](figs/img-003.png)\n" and convert(b.build()) == ("\n", [])
    assert images.cmyk_to_rgb(bytes([0, 100, 255, 10])) == bytes([245, 145, 0])
    raw = files[1][1]
    size = int.from_bytes(raw[33:37], "big")
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(raw[41 : 41 + size]) == b"\0ABCDEF" and zlib.crc32(raw[37 : 41 + size]) == int.from_bytes(raw[41 + size : 45 + size], "big")
    assert zlib.decompress(images.png(300, 300, 1, bytes(90_000))[41:-16]) == (b"\0" + bytes(300)) * 300


# ---------------------------------------------------------------- layout


def span(text, x, y, size=12.0, **more):
    return Span(text, f32(x), f32(y), f32(len(text.encode()) * size * 0.5), f32(size), f32(size), **more)


def page(*spans, rects=(), roles=None):
    return format_page(list(spans), list(rects), roles or {}, 0, set())


def raw(text):
    spans, y = [], 1000.0
    for line in text.split("\n"):
        if line.strip():
            spans.append(span(line.strip(), 0, y))
            y -= 14
        else:
            y -= 24
    return format_page(spans, [], {}, 0, set())


@pytest.mark.parametrize(
    "text, out",
    [
        ("This is a paragraph\nthat wraps across\ntwo lines.", "This is a paragraph that wraps across two lines."), ("INTRODUCTION\n\nBody copy goes here.", "## INTRODUCTION\n\nBody copy goes here."),
        ("Abstract\n\nBody.", "### Abstract\n\nBody."), ("Introduction\n\nBody.", "# Introduction\n\nBody."), ("- apples\n- pears", "- apples\n- pears"), ("• alpha\n• beta", "- alpha\n- beta"),
        ("1. first\n2) second", "1. first\n2. second"), ("\n\n", ""), ("1.2 Details", "## Details"), ("1. Overview", "1. Overview"), ("1 Intro", "# Intro"), ("1.2 It ends in a stop.", "1.2 It ends in a stop."),
        ("hyphen-\nation works", "hyphenation works"), ("hyphen-\nAtion", "hyphen- Ation"), ("Title Case Line", "Title Case Line"),
    ],
)
def test_text_pages(text, out):
    assert raw(text) == out


def test_line_shapes():
    assert [heading_level(x) for x in ("1.2.3 Sub", "1.1.1.1.1.1.1 x", "ALL CAPS", "Short title", "short", "A; b", "x" * 121, "Ends.")] == [3, 6, 2, 3, None, None, None, None]
    assert numbered("1. x") and not numbered("1.x") and strip_number("1.2.  x") == "x" and named_section(" References ") == 2 and not all_caps("1234") and not all_caps(" ".join(["A"] * 13))
    assert list_item("-no") is None and list_item("⁃  yes ") == "- yes" and list_item("12)\tx") == "12. x"


def test_span_pages():
    assert page(span("Big Title", 50, 700, 24), span("body text here, plenty of it", 50, 660)).startswith("# Big Title")
    both = [span("L", 20, 700 - 14 * i) for i in range(4)] + [span("R", 320, 700 - 14 * i) for i in range(4)]
    assert page(*both) == "L L L L\n\nR R R R"
    assert page(span("Tagged", 50, 700, mcid=1), roles={(0, 1): ("heading", 2)}) == "## Tagged"
    assert page(span("loud.", 0, 700, bold=True)) == "**loud.**" and page(span("soft.", 0, 700, italic=True)) == "*soft.*" and page(span("both.", 0, 700, bold=True, italic=True)) == "***both.***"
    assert page(span("x = 1", 0, 700, mono=True), span("y = 2", 0, 686, mono=True)) == "```\nx = 1\ny = 2\n```"
    assert page(span("i.png", 0, 700, image=True)) == "\x01i.png\x01"


def test_tables():
    cells = [span("Name", 20, 700), span("Age", 200, 700), span("Ada", 20, 686), span("36", 200, 686)]
    assert page(*cells) == "| Name | Age |\n| --- | --- |\n| Ada | 36 |"
    rects = [(0, 0, 100, 40), (0, 0, 50, 40), (0, 20, 100, 20)]
    ruled = [span(t, x, y, 10) for t, x, y in (("A", 5, 28), ("B", 60, 28), ("C|c", 5, 8), ("D", 60, 8))]
    assert page(*ruled, rects=rects) == "| A | B |\n| --- | --- |\n| C\\|c | D |"
    assert "---" not in page(*ruled[:1], rects=rects) and "above\n\n|" in page(span("above", 5, 100, 10), *ruled, rects=rects)
    assert gfm([["a"]]) is None and gfm([["a", "b"], ["c"]]) == "| a | b |\n| --- | --- |\n| c |  |"
    assert cluster([1, 2, 3, 10, 11, 30]) == [2.0, 10.5, 30.0] and cluster([]) == []


def test_margins_and_columns():
    pages = [[span("CONFIDENTIAL", 50, 780, 9), span(f"Body {i} text here.", 50, 700), span("Page 1 of 3", 50, 40, 9)] for i in range(3)]
    assert running_margins(pages) == {"CONFIDENTIAL", "Page 1 of 3"} and running_margins(pages[:2]) == set()
    assert format_pages([(p, []) for p in pages], {}) == [f"Body {i} text here." for i in range(3)]
    assert column_gaps([0.0] * 4 + [300.0] * 4) == [f32(300 * 12.5 / 24)] and column_gaps([0.0] * 4 + [100.0] * 4) == []
    assert median_size([span("aa", 0, 0, 10), span("a", 0, 0, 20)]) == 10 and median_size([]) == 12.0


def test_assembly():
    mark = "\x01"
    assert link_images(f"before{mark}img-001.jpg{mark}after{mark}img-002.jpg{mark}.", "figs/") == "before![](figs/img-001.jpg)after![](figs/img-002.jpg)."
    assert link_images(f"open {mark}x", "f") == f"open {mark}x"
    assert promote_title("Some Title\n\nFirst.") == "# Some Title\n\nFirst." and promote_title("two\nlines\n\nx") == "two\nlines\n\nx"
    for same in ("# has", "![](x)", "", "  \n"):
        assert promote_title(same) == same
    assert assemble(["a", " ", "b"], True) == "# a\n\n---\n\nb\n" and assemble([]) == "\n"
    assert literal("a(b)\\") == b"(a\\(b\\)\\\\)"


def test_arrays_of_many_words():
    """Words that numbers move apart are taken in one go, and give what each of them shown alone gives."""
    words = ["w%d" % (i % 97) for i in range(3000)]
    lines = [words[i : i + 60] for i in range(0, len(words), 60)]

    def built(joint: bytes, end: bytes) -> bytes:
        b = Builder()
        font = b.font()
        show = lambda t: b"[" + joint.join(b"(%s)" % w.encode() for w in t.split(" ")) + end
        b.page(text_content([" ".join(x) for x in lines], show=show), b"/Font <</F1 %d 0 R>>" % font)
        return b.build()

    def spans(data: bytes):
        return [[getattr(s, k) for k in s.__slots__] for s in extract(data).pages[0][0]]

    calls = []
    whole, show = Page._show, Page._show
    Page._show = lambda self, state, raw: calls.append(1) or show(self, state, raw)
    try:
        fast, n = spans(built(b" -250 ", b"] TJ")), len(calls)
        slow = spans(built(b" -250 ", b" /Odd] TJ").replace(b") -250 (", b")] TJ\n[-250 ("))
        again = spans(built(b" -250 ] TJ\n[", b"] TJ"))
    finally:
        Page._show = whole
    assert fast == again and [s[0] for s in fast] == [" ".join(x) for x in lines]
    assert [s[0] for s in slow] == [s[0] for s in fast]
    assert n == len(lines)
    odd = Page({}, {})
    odd.run(b"BT /F 9 Tf 1 0 0 1 5 5 Tm [(a) 5 (b) -100 () (c ) -200 (d) -7 <65> (\\146) -300] TJ [(g)] TJ ET", {b"F": Font(Document(built(b" ", b"] TJ")), Ref(3, 0))}, {})
    assert [s.text for s in odd.spans] == ["ab c def g"]


def test_texts_of_fonts():
    """Tables with texts of several characters or none, and codes of two bytes with one left over."""
    font = Font.__new__(Font)
    font.table, font._chars, font.map = ["x"] * 250 + [None, "", "fi", "\ufffe", "\u00e9", "z"], None, None
    assert font.text(bytes([0, 250, 251, 252, 253, 254, 255])) == "xfi\ufffe\u00e9z"
    font.table, font._chars = ["x"] * 252 + ["fi", "", "\u00e9", "z"], None
    assert font.text(bytes(range(250, 256))) == "xxfi\u00e9z" and not font.single()
    font.table, font._chars = ["x"] * 252 + [None, "", "\u00e9", "z"], None
    assert font.text(bytes(range(250, 256))) == "xx\u00e9z"
    font.table, font.width, font.map = None, 2, CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 3 beginbfchar <0001> <0041> <0102> <00660069> <0003> <0043> endbfchar")
    assert font.text(b"\0\1\1\2\7\7\3") == "AfiC"


def test_usual_entries_are_read_in_one_go(monkeypatch):
    """Dictionaries, heads of objects and of object streams that are read in one go are the same piece by piece."""
    from vellumine.kernel import document, objects
    from vellumine.testing.pdf_builder import text_pdf

    never = __import__("re").compile(rb"(?!)")
    parts = [b"/A", b"/B#41", b"/Type/Page", b"1", b"12 0 R", b"12  3\tR", b"1234567890 0 R", b"120 R", b"7 99999 R", b"12 0 Rx", b"-1", b"+2", b"1.5", b"[0 0 612 792]", b"[ 1 2 ]", b"[]", b"[1 0 R]", b"[1 2 0 R 3]", b"<</K 1>>", b"(s)", b"<41>", b"true", b"null", b"% c\n", b" ", b"\n", b"\0", b">>", b"]", b"12 0 R/X", b"/N 007", b"9999999999999999999"]
    rng = random.Random(5)
    bodies = [b"<<" + b"".join(rng.choice([b"", b" "]) + rng.choice(parts) for _ in range(rng.randrange(1, 7))) + b">>" for _ in range(6000)]
    bodies += [b"<</A 1 /B 2 0 R /C /D /E [1 2]>>", b"<<" + b"/A 1" * 5000 + b">>", b"<<" + b"/A " * 1 + b"[" * 300 + b"]" * 300 + b">>", b"<</A " * 256 + b"[1]" + b">>" * 256, b"<</A " * 255 + b"[1]" + b">>" * 255]
    bodies += [h + b"<</A 1>>" for h in (b"1 0 obj", b"1 0obj", b" 1\t0 obj", b"1 % c\n0 obj", b"9999999999 0 obj", b"1 123456 obj", b"1 70000 obj")]

    def read(body):
        try:
            p = objects.Parser(body)
            value = p.value() if body.startswith(b"<") else p.indirect()
            return value, repr(value), p.pos
        except PdfError as e:
            return e.code

    got = [read(b) for b in bodies]
    calls, value = [], objects.Parser.value
    monkeypatch.setattr(objects.Parser, "value", lambda self: (calls.append(1), value(self))[1])
    files = [text_pdf([["a", "b"], ["c"]], packed=p) for p in (True, False)]
    docs = [document.Document(f) for f in files]
    few = len(calls)
    monkeypatch.setattr(objects, "_USUAL_ENTRY", never)
    monkeypatch.setattr(objects, "_USUAL_START", never)
    monkeypatch.setattr(document, "_USUAL_HEADS", never)
    assert got == [read(b) for b in bodies]
    calls.clear()
    for own, f in zip(docs, files):
        again = document.Document(f)
        assert (own.objects, own.pages, own.trailer) == (again.objects, again.pages, again.trailer)
    assert 2 * few < len(calls)


def test_numerals_in_single_precision():
    from vellumine.kernel.objects import f32, f32_of

    for x in ([], [b"1", b"-.5", b"0.1"], [b"1" * 60, b"2"], [b"%d.3" % i for i in range(12)]):
        assert f32_of(x) == [f32(float(v)) for v in x]

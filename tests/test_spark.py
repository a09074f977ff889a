"""The Spark side: agreement with the kernel, sources, sinks, API, SQL, streaming, CLI."""

import io
import random

import pytest
from pyspark.sql import functions as F

from vellumine import cli
from vellumine.functions import lines as L
from vellumine.functions import markdown as M
from vellumine.kernel import layout as kernel
from vellumine.kernel import lines as K
from vellumine.kernel.content import Span
from vellumine.kernel.objects import PdfError, f32
from vellumine.operators import decode, layout, text
from vellumine.plans import api
from vellumine.plans.metrics import token_quality
from vellumine.sources import files, sinks
from vellumine.streaming.convert import stream_folder, write_stream
from vellumine.testing.pdf_builder import Builder, text_pdf

LINES = [
    "1.2 Details", "1. Overview", "1.Intro", "12) x", "INTRODUCTION", "ALL CAPS, REALLY.", "Short Title Here", "prose that goes on; and on", "Abstract", " References ", "- item", "• wide", "* ", "-no",
    "ÉCOLE NORMALE", "Größe 12", "x" * 121, "É" * 61, "1.1.1.1.1.1.1.1 deep", "٣. not ascii", "", "1234", "A B C D E F G H I J K L M", "a b c d e f g h i j k", "日本語", "ⅣⅤ", "Ends.", "Comma,", "7. nbsp",
]
SPANS = "doc_id long, page_idx int, seq int, text string, x float, y float, width float, height float, font_size float, bold boolean, italic boolean, mono boolean, kind string, mcid bigint, space_before boolean"


def test_line_functions_agree_with_the_kernel(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "i int, t string")
    c = F.col("t")
    rows = df.select("t", L.trim(c).alias("trim"), L.word_count(c).alias("words"), L.heading_shaped(c).alias("shaped"), L.all_caps(c).alias("caps"), L.numbered(c).alias("num"), L.short_title(c).alias("short"),
                     L.heading_level(c).alias("level"), L.strip_number(c).alias("bare"), L.named_section(c).alias("section"), L.list_item(c).alias("item"), L.is_list_item(c).alias("listed")).collect()
    for r in rows:
        t = r.t
        item = K.list_item(t)
        assert (r.trim, r.words, r.shaped, r.caps, r.num, r.short, r.level, r.section) == (t.strip(K.WS), K.words(t), K.heading_shaped(t), K.all_caps(t), K.numbered(t), K.short_title(t), K.heading_level(t), K.named_section(t)), t
        assert (r.bare, r.listed, r.item) == (K.strip_number(t), item is not None, t if item is None else item), t


def test_markdown_functions_agree_with_the_kernel(spark):
    texts = ["Title\n\nbody", "  lead\n\nx", "# has", "![](x)", "", "a\nb\n\nc", "one", "\n\n", "x\x01f.png\x01y\x01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", M.promote_title(F.col("t")).alias("p"), M.link_images(F.col("t"), "f$1\\/").alias("l"), M.end_line(F.col("t")).alias("e")).collect():
        assert (r.p, r.e) == (kernel.promote_title(r.t), r.t if r.t.endswith("\n") else r.t + "\n")
        assert r.l == kernel.link_images(r.t, "f$1\\/")
    paras = [["a-", "b"], ["a-", "B"], ["a ", "b"], ["", "b"], ["x"], [], ["-", "a-", "é"]]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paras)], "i int, p array<string>").orderBy("i").select(M.join_paragraph(F.col("p")).alias("m")).collect()
    assert [r.m for r in got] == [kernel.paragraph(p) if p else "" for p in paras]
    tables = [[["a", "b|"], ["c"]], [["a"]], [["x", "y", "z"]]]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, t array<array<string>>").orderBy("i").select(M.gfm_table(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [kernel.gfm(t) for t in tables]


def test_text_pages_agree_with_the_kernel(spark):
    rng = random.Random(1)
    docs = ["\n".join(rng.choice([*LINES, "", "hyphen-", "ation works", "plain line of prose"]) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.md for r in df.select("doc_id", text.text_page(F.col("text")).alias("md")).collect()}
    spans = layout.text_layout(df.withColumn("page_idx", F.lit(0)), ["doc_id", "page_idx"])
    again = {r.doc_id: r.markdown for r in layout.format_spans(spans).collect()}
    for i, t in enumerate(docs):
        own, y = [], 1000.0
        for line in t.split("\n"):
            if line.strip(K.WS):
                own.append(Span(line.strip(K.WS), 0.0, y, f32(6.0 * len(line.strip(K.WS).encode())), 12.0, 12.0))
                y -= 14
            else:
                y -= 24
        want = kernel.format_page(own, [], {}, 0, set())
        assert got[i] == want and again.get(i, "") == want


def random_spans(rng, docs=12):
    rows = []
    for d in range(docs):
        for p in range(rng.randrange(1, 5)):
            for s in range(rng.randrange(0, 25)):
                image = rng.random() < 0.1
                t = "img" if image else rng.choice(["Head", "word", "x y", "Page 1", " ", "long text in here"])
                size = rng.choice([9.0, 12.0, 18.0])
                rows.append((d, p, s, t, float(rng.randrange(0, 400)), float(rng.choice([780, 40, *range(100, 700, 7)])), len(t) * size * 0.5, size, size, rng.random() < 0.2, False, False, "image" if image else "text", None, rng.random() < 0.5))
    return rows


def as_pages(rows):
    pages = {}
    for d, p, _, t, x, y, w, h, size, b, i, m, kind, mcid, space in sorted(rows, key=lambda r: r[:3]):
        pages.setdefault(d, {}).setdefault(p, []).append(Span(t, x, y, f32(w), h, size, b, i, m, kind == "image", mcid, space))
    return pages


def test_layout_operators_agree_with_the_kernel(spark):
    rows = random_spans(random.Random(2))
    pages = as_pages(rows)
    spans = spark.createDataFrame(rows, SPANS)
    margins = layout.running_margins(spans, ["doc_id"])
    assert {(r.doc_id, r.text) for r in margins.collect()} == {(d, t) for d, p in pages.items() for t in kernel.running_margins([p[i] for i in sorted(p)])}
    lines = layout.visual_lines(spans, ["doc_id", "page_idx"]).collect()
    assert sorted((r.doc_id, r.page_idx, r.line, r.y, r.text) for r in lines) == sorted((d, p, i, line.y, line.plain) for d, own in pages.items() for p, s in own.items() for i, line in enumerate(kernel.visual_lines(s)))
    medians = {(r.doc_id, r.page_idx): r["median"] for r in layout.weighted_median(spans.where("kind = 'text'").withColumn("w", F.octet_length("text")), ["doc_id", "page_idx"], "font_size", "w").collect()}
    assert medians == {(d, p): kernel.median_size(s) for d, own in pages.items() for p, s in own.items() if any(not x.image for x in s)}
    kept = layout.strip_margins(spans, margins, ["doc_id"]).collect()
    want = []
    for d, own in pages.items():
        drop = kernel.running_margins([own[i] for i in sorted(own)])
        for p, s in own.items():
            ys = [line.y for line in kernel.visual_lines(s) if line.plain in drop]
            want += [(d, p, x.text, x.x, x.y) for x in s if x.image or all(abs(x.y - y) > 2 for y in ys)]
    assert sorted((r.doc_id, r.page_idx, r.text, r.x, r.y) for r in kept) == sorted(want)


def test_columns_clusters_cells(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 10.0, 300.0, 320.0, 640.0]) + rng.random()) for k in range(10) for _ in range(rng.choice([5, 60]))]
    got = {r.k: r.gaps for r in layout.column_gaps(spark.createDataFrame(rows, "k int, x double"), ["k"]).collect()}
    for k in range(10):
        assert got[k] == pytest.approx(kernel.column_gaps([x for j, x in rows if j == k]), rel=1e-5)
    assert spark.range(1).select(layout.column_of(F.lit(5.0), F.array(F.lit(1.0), F.lit(9.0))).alias("c")).first().c == 1
    values = [[float(rng.randrange(60)) for _ in range(n)] for n in (0, 1, 7, 30)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>").orderBy("i")
    for r, v in zip(df.select(layout.cluster_edges(F.col("v")).alias("e")).collect(), values):
        assert r.e == pytest.approx(kernel.cluster(v))
    edges = F.array(*map(F.lit, (1.0, 3.0, 7.0)))
    got = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.9, 3.0, 7.0)], "x double").select(layout.cell_of(F.col("x"), edges).alias("c")).collect()
    assert [r.c for r in got] == [None, 0, 0, 1, None]


def test_awkward_spans(spark):
    rows = [(None, 0, 0, "x", 0.0, 0.0, 1.0, 1.0, 1.0, False, False, False, "text", None, False), (1, None, 0, "x", 0.0, 0.0, 1.0, 1.0, 1.0, False, False, False, "text", None, False),
            (2, 0, 0, None, 0.0, 9.0, 1.0, 1.0, 12.0, None, None, None, "text", None, None), (2, 0, 1, "kept text.", 0.0, 40.0, 1.0, 1.0, 12.0, None, None, None, "text", None, None)]
    spans = spark.createDataFrame(rows, SPANS)
    assert [(r.doc_id, r.page_idx, r.markdown) for r in layout.format_spans(spans).collect()] == [(2, 0, "kept text.")]
    assert layout.format_spans(spans.limit(0)).count() == 0 and layout.running_margins(spans, ["doc_id"]).count() == 0


GOOD = text_pdf([["My Title", "", "Body text."], ["1.2 More", "", "- a", "- b"]])
MARKDOWN = "# My Title\n\nBody text.\n\n## More\n\n- a\n- b\n"


def image_pdf():
    b = Builder()
    i = b.stream(b"JPEG", b"/Subtype /Image /Filter /DCTDecode /Width 1 /Height 1")
    b.page(b"/I Do", b"/XObject <</I %d 0 R>>" % i)
    return b.build()


def test_convert_documents(spark):
    rows = [(1, GOOD, "x"), (2, b"junk", "y"), (3, None, "z"), (4, b"", "w"), (1, GOOD, "x")]
    df = spark.createDataFrame(rows, "id int, content binary, markdown string").withColumn("Error", F.lit(5))
    got = decode.convert_documents(df)
    assert got.columns == ["id", "markdown", "images", "error"]
    assert sorted((r.id, r.markdown, r.error and r.error.code) for r in got.collect() if r.markdown) == [(1, MARKDOWN, None)] * 2
    assert {r.id: r.error.code for r in got.collect() if r.error} == {2: "NOT_PDF", 3: "NOT_PDF", 4: "NOT_PDF"}
    assert decode.convert_documents(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="does not look like a PDF"):
        decode.convert_documents(df, mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        decode.convert_documents(df, mode="x")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_decode_tables(spark):
    b = Builder()
    font = b.font(b"Courier-Bold")
    page = b.page(b"/P <</MCID 0>> BDC BT /F1 12 Tf 50 700 Td (Hi) Tj ET EMC 10 10 100 30 re", b"/Font <</F1 %d 0 R>>" % font)
    root = b.add(b"<</K <</S /H2 /Pg %d 0 R /K 0>>>>" % page)
    b.catalog_extra = b"/StructTreeRoot %d 0 R" % root
    df = spark.createDataFrame([("d", b.build()), ("i", image_pdf()), ("bad", b"x")], "doc_id string, content binary")
    out = decode.decode_documents(df, with_images=True)
    spans = decode.spans(out)
    assert [(r.doc_id, r.text, r.x, r.y, r.bold, r.mono, r.mcid) for r in spans.where("kind = 'text'").collect()] == [("d", "Hi", 50.0, 700.0, True, True, 0)]
    assert [tuple(r)[3:] for r in decode.rects(out).collect()] == [(10.0, 10.0, 100.0, 30.0)]
    assert [tuple(r) for r in decode.roles(out).collect()] == [("d", 0, 0, "heading", 2)]
    assert [tuple(r) for r in decode.images(out).collect()] == [("i", 1, "img-001.jpg", b"JPEG")]
    pages = layout.format_spans(spans, decode.rects(out), decode.roles(out)).collect()
    assert {(r.doc_id, r.markdown) for r in pages} == {("d", "## Hi"), ("i", "\x01img-001.jpg\x01")}


def test_api(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("b.pdf", GOOD), ("a.PDF", image_pdf()), ("bad.pdf", b"junk"), ("note.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    one = api.convert(memoryview(GOOD))
    assert one.markdown == MARKDOWN and api.convert_file(tmp_path / "in" / "b.pdf").markdown == MARKDOWN and "0 images" in repr(one)
    pic = api.convert(image_pdf(), image_dir="figs")
    assert pic.write_images(tmp_path / "figs")[0].read_bytes() == b"JPEG" and one.write_images(tmp_path / "none") == [] and (tmp_path / "none").is_dir()
    with pytest.raises(TypeError):
        api.convert("text")
    many = api.convert_many(spark, [GOOD, str(tmp_path / "in" / "a.PDF"), bytearray(GOOD)], workers=2)
    assert [m.markdown for m in many] == [MARKDOWN, "\n", MARKDOWN] and api.convert_many(spark, []) == []
    with pytest.raises(ValueError):
        api.convert_many(spark, [GOOD], workers=0)
    with pytest.raises(PdfError):
        api.convert_many(spark, [GOOD, b"junk"])
    assert api.convert_folder(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"converted": 2, "failed": 1}
    assert (tmp_path / "out" / "b.md").read_text() == MARKDOWN and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.md", "b.md"]
    got = api.convert_files(spark, str(tmp_path / "in" / "*.pdf"), mode="PERMISSIVE").collect()
    assert {(r.stem, r.error is None) for r in got} == {("b", True), ("bad", False)}
    assert sinks.write_images(decode.convert_documents(files.read_folder(spark, str(tmp_path / "in")), image_dir="x"), str(tmp_path / "pics"), "stem").count() == 1
    assert (tmp_path / "pics" / "a" / "img-001.jpg").read_bytes() == b"JPEG"


def test_sql(spark, tmp_path):
    api.register(spark)
    spark.createDataFrame([(1, GOOD), (2, b"x"), (3, None)], "id int, content binary").createOrReplaceTempView("raw_files")
    rows = spark.sql("SELECT id, r.markdown, r.error.code FROM (SELECT id, pdf_to_markdown(content) AS r FROM raw_files)").collect()
    assert {(r.id, r.markdown, r.code) for r in rows} == {(1, MARKDOWN, None), (2, None, "NOT_PDF"), (3, None, "NOT_PDF")}
    spans = spark.sql("SELECT id, s.text FROM raw_files, LATERAL pdf_spans(content) s").collect()
    assert {r.text for r in spans} == {"My Title", "Body text.", "1.2 More", "- a", "- b"}
    (tmp_path / "x.pdf").write_bytes(GOOD)
    (tmp_path / "y.pdf").write_bytes(b"junk")
    got = spark.read.format("pdf").option("filesPerPartition", "1").load(str(tmp_path)).collect()
    assert {(r.path[-5:], r.markdown, r.error and r.error.code) for r in got} == {("x.pdf", MARKDOWN, None), ("y.pdf", None, "NOT_PDF")}


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(GOOD)
    for name, data in ((None, None), ("b.pdf", b"junk")):
        if name:
            (tmp_path / "in" / name).write_bytes(data)
        q = write_stream(stream_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path[-5:], r.error is None) for r in rows) == [("a.pdf", True), ("b.pdf", False)]


def test_cli(tmp_path):
    (tmp_path / "a.pdf").write_bytes(GOOD)

    def run(*argv, stdin=None):
        out, err = io.StringIO(), io.StringIO()
        return cli.main([str(a) for a in argv], stdin and io.BytesIO(stdin), out, err), out.getvalue(), err.getvalue()

    assert run(tmp_path / "a.pdf") == (0, MARKDOWN, "") and run("-", stdin=GOOD)[1] == MARKDOWN
    assert run(tmp_path / "a.pdf", "--page-breaks")[1].count("---") == 1
    assert run(tmp_path / "a.pdf", "--output=" + str(tmp_path / "o.md"))[1] == "" and (tmp_path / "o.md").read_text() == MARKDOWN
    assert run("-", "--extract-images", tmp_path / "figs", stdin=image_pdf())[1] == f"![]({tmp_path}/figs/img-001.jpg)\n" and (tmp_path / "figs" / "img-001.jpg").exists()
    for bad in ([tmp_path / "none.pdf"], [tmp_path / "a.pdf", "--nope"], [tmp_path / "a.pdf", "-o"], [tmp_path / "a.pdf", "b.pdf"], []):
        code, out, err = run(*bad)
        assert code == 1 and err.startswith("error: ") and not out
    assert run("-", stdin=b"junk")[2] == "error: input does not look like a PDF\n"


def test_url_source():
    assert files.is_url("https://x/y.pdf") and not files.is_url("/a/b.pdf") and not files.is_url("-")
    with pytest.raises(OSError, match="can't be run"):
        files.fetch("http://example.invalid/x", command="no-such-command")
    with pytest.raises(OSError, match="failed"):
        files.fetch("http://example.invalid/x", command="false")


def test_token_quality(spark):
    a = spark.createDataFrame([(1, "The cat the Cat"), (2, None), (3, "x")], "k int, text string")
    b = spark.createDataFrame([(1, "the dog cat cat cat"), (4, "y")], "k int, text string")
    got = {r.k: (r.found, r.expected, r.common, r.recall, r.precision) for r in token_quality(a, b, "k").collect()}
    assert got == {1: (4, 5, 3, 0.6, 0.75), 3: (1, 0, 0, None, 0.0), 4: (0, 1, 0, 0.0, None)}


def test_sinks_and_source_take_uris(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a", "# A\n", [("img-001.png", b"P")]), ("b", None, None)], "stem string, markdown string, images array<struct<filename: string, bytes: binary>>")
    assert [tuple(r) for r in sinks.write_markdown(rows, out).collect()] == [("a.md", f"{out}/a.md", 4)]
    assert sinks.write_images(rows, out, "stem").count() == 1
    assert (tmp_path / "out" / "a.md").read_text() == "# A\n" and (tmp_path / "out" / "a" / "img-001.png").read_bytes() == b"P"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "a.md"]
    (tmp_path / "out" / "x.PDF").write_bytes(text_pdf([["One"]]))
    files.register(spark)
    got = spark.read.format("pdf").load(out).collect()
    assert [(r.path, r.markdown) for r in got] == [(f"{out}/x.PDF", "# One\n")]


def test_many_lines_of_one_text(spark):
    """Blocks, paragraphs and visual lines take time in proportion to their lines."""
    n = 100_000
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("some words, "), i.cast("string"))), "\n").alias("text"))
    page = docs.select(text.text_page(F.col("text")).alias("m")).first().m
    assert page.count("some words, ") == n and "\n" not in page
    lines = layout.visual_lines(layout.text_layout(docs, ["doc_id"]), ["doc_id"])
    assert lines.agg(F.count("*"), F.max("line")).first()[:] == (n, n - 1)


def test_folders_are_listed_by_the_executors(spark, tmp_path):
    """Neither a list on the driver nor a task for a few small files, whatever their number."""
    for n in range(300):
        own = tmp_path / "in" / str(n // 10) / ("deep" if n % 2 else ".")
        own.mkdir(parents=True, exist_ok=True)
        (own / f"{n}.pdf").write_bytes(GOOD if n % 3 else b"junk")
    (tmp_path / "in" / "top.PDF").write_bytes(GOOD)
    (tmp_path / "in" / "0" / "_hidden.pdf").write_bytes(GOOD)
    (tmp_path / "in" / "0" / "note.txt").write_bytes(b"no")
    folder = str(tmp_path / "in")
    found = files.read_folder(spark, folder, recursive=True)
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.stem for r in found.select("stem").collect()) == sorted([*map(str, range(300)), "top"])
    flat, jvm = files.read_folder(spark, folder), files.read_files(spark, folder, files.PDF_GLOB)
    assert flat.drop("stem").schema == jvm.schema or [f.dataType for f in flat.drop("stem").schema] == [f.dataType for f in jvm.schema]
    assert [(r.path, r.length, bytes(r.content)) for r in flat.collect()] == [(r.path, r.length, bytes(r.content)) for r in jvm.collect()]
    files.register(spark)
    got = spark.read.format("pdf").option("recursiveFileLookup", "true").load(folder)
    assert got.rdd.getNumPartitions() == 31
    assert sorted((r.path.rpartition("/")[2], r.error is None) for r in got.collect()) == sorted([("top.PDF", True), *((f"{n}.pdf", n % 3 != 0) for n in range(300))])
    assert spark.read.format("pdf").load(folder).count() == 1


def test_rows_are_dealt_to_tasks_of_some_megabytes(spark):
    """A large table gives more tasks, not larger ones, and no batch of Arrow's largest size."""
    from vellumine.plans.queries import PART, as_pdf, dealt, predictor_roundtrip

    rows = spark.range(4_000_000)
    assert dealt(rows).rdd.getNumPartitions() == -(-8 * 4_000_000 // PART) and dealt(spark.range(3)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert as_pdf(rows.withColumn("t", F.lit(1)), "id", "t", lambda _: b"").rdd.getNumPartitions() > 16
    assert "RoundRobinPartitioning" in predictor_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_broken_files_grow_in_number(spark):
    """A larger table gives ``pdf_errors`` more tasks in proportion, so that none of them fills larger batches."""
    from vellumine.plans.queries import pdf_errors

    factor, sf, parts = "spark.sql.sources.fileCompressionFactor", "/root/testdata/sf0.01", []
    old = spark.conf.get(factor)
    try:
        for times in (100, 1000):  # the plan takes the table for so many times its size
            spark.conf.set(factor, str(float(times)))
            parts.append(pdf_errors(spark, sf).rdd.getNumPartitions())
    finally:
        spark.conf.set(factor, old)
    assert parts[0] > 16 and abs(parts[1] / parts[0] - 10) < 1


def test_parts_of_visual_lines_grow_in_number(spark, tmp_path):
    """A task sorts some megabytes of spans, however many there are; a plan without an estimate has the usual parts."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(6_000_000)
    assert layout.parted(rows, ["id"]).rdd.getNumPartitions() == -(-8 * 6_000_000 // layout.PART) > usual
    unknown = spark.sparkContext.parallelize([(1,)]).toDF("id long")
    assert layout.estimated(unknown) is None and layout.parted(unknown, ["id"]).rdd.getNumPartitions() == usual
    spans = rows.select(F.col("id").alias("k"), F.lit(0).alias("seq"), *(F.lit(1.0).cast("float").alias(c) for c in ("x", "y", "font_size")), F.lit("t").alias("text"), F.lit("text").alias("kind"), F.lit(False).alias("space_before"))
    plan = layout.visual_lines(spans, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1


def test_codecs_hold_few_values_at_a_time():
    """What Python holds of a batch is bounded, whatever the batch; nulls and empty batches stay."""
    import pyarrow as pa

    from vellumine.functions import codecs

    n = 2 * codecs.SLICE + 7
    values = pa.array([None if i % 5 == 0 else str(i) for i in range(n)], pa.string())
    got = codecs.mapped(str.encode, values)
    assert got.type == pa.binary() and got.to_pylist() == [None if i % 5 == 0 else str(i).encode() for i in range(n)]
    assert codecs.mapped(str.encode, values.slice(0, 0)).to_pylist() == []


def test_spans_are_read_few_documents_at_a_time(spark, monkeypatch):
    """What Python holds of a table of spans is bounded, whatever the batch; fields are read column by column."""
    rows = [(d, 0, s, f"t{s}", 50.0, 700.0 - 14 * s, 9.0, 12.0, 12.0, None, True, False, None, 3 if s else None, None) for d in range(2 * layout.SLICE + 7) for s in range(2)]
    table = spark.createDataFrame(rows, SPANS).coalesce(1)
    fields = ["page_idx", "seq", *(c for c in table.columns if c not in ("doc_id", "page_idx", "seq"))]
    lists = table.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans")).toArrow().column("spans").combine_chunks()
    want = [[(s["page_idx"], s["text"] or "", s["y"], bool(s["bold"]), bool(s["italic"]), s["kind"] == "image", s["mcid"], bool(s["space_before"])) for s in own] for own in lists.slice(5, 9).to_pylist()]
    assert [[(p, s.text, s.y, s.bold, s.italic, s.image, s.mcid, s.space) for p, s in own] for own in layout.spans_of(lists.slice(5, 9))] == want
    assert layout.format_spans(table).count() == 2 * layout.SLICE + 7


def test_results_are_passed_on_by_their_size():
    """Small files with large images aren't held together, however many there are in a batch."""
    import pyarrow as pa

    from vellumine.kernel.convert import convert

    b = Builder()
    n = b.stream(bytes(3 << 20), b"/Type /XObject /Subtype /Image /Width 1048576 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8", flate=True)
    b.page(b"/I Do", b"/XObject <</I %d 0 R>>" % n)
    large = b.build()
    assert len(large) < 1 << 16
    batch = pa.RecordBatch.from_pydict({"i": [*range(8)], "__content": [large if i % 2 else GOOD for i in range(8)]})

    def one(raw: bytes) -> dict:
        files = convert(raw, False, "f")[1]
        return {"images": [{"filename": n, "bytes": x} for n, x in files]}

    schema = pa.schema([("i", pa.int64()), ("images", pa.list_(pa.struct([("filename", pa.string()), ("bytes", pa.binary())])))])
    got = [*decode.results(iter([batch]), one, ["i"], ["images"], schema, "PERMISSIVE")]
    assert [x.column("i").to_pylist() for x in got] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert [len(x) for y in got for x in y.column("images").to_pylist()] == [0, 1] * 4


def test_results_are_passed_on_by_what_comes_of_small_files(spark):
    """Files are compressed: what is held is bounded by the Markdown and the spans of them too."""
    import pyarrow as pa

    from vellumine.kernel.convert import convert

    small = text_pdf([["the same line of some words comes again and again"] * 12_000], packed=True)
    assert len(small) < 1 << 16 and len(convert(small)[0]) > 1 << 19
    batch = pa.RecordBatch.from_pydict({"i": [*range(8)], "__content": [small] * 8})
    schema = pa.schema([("i", pa.int64()), ("markdown", pa.string())])
    got = [*decode.results(iter([batch]), lambda raw: {"markdown": convert(raw)[0]}, ["i"], ["markdown"], schema, "PERMISSIVE")]
    assert [x.column("i").to_pylist() for x in got] == [[0, 1, 2, 3], [4, 5, 6, 7]] and len({x for y in got for x in y.column("markdown").to_pylist()}) == 1

    df = spark.createDataFrame([(i, small) for i in range(3)], "doc_id long, content binary").coalesce(1)
    assert sorted(decode.spans(decode.decode_documents(df)).groupBy("doc_id").count().collect()) == [(i, 12_000) for i in range(3)]
    schema, pages = pa.schema([("i", pa.int64()), ("n", pa.int64())]), [{"spans": [{}] * 2000, "rects": []}]
    got = [*decode.results(iter([batch]), lambda raw: {"pages": pages, "n": 1}, ["i"], ["n"], schema, "PERMISSIVE")]
    assert [x.column("i").to_pylist() for x in got] == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_files_are_passed_on_by_their_size():
    """A batch of large files isn't held whole; of small ones 200 are passed on at a time, as they were."""
    import pyarrow as pa

    from vellumine.plans.queries import built

    batch = pa.RecordBatch.from_pydict({"i": [*range(405)], "n": [1 << 20] * 4 + [1] * 401})
    got = [*built(iter([batch, batch.slice(0, 0)]), lambda n: bytes(n), "i")]
    assert [x.num_rows for x in got] == [2, 2, 200, 200, 1] and got[0].schema.names == ["i", "content"]
    assert [v for x in got for v in x.column("i").to_pylist()] == [*range(405)]
    assert [len(v) for x in got for v in x.column("content").to_pylist()] == [1 << 20] * 4 + [1] * 401


def test_last_lines_that_turns_share_stay(spark, tmp_path):
    """Only the running head of a conversation goes, as in the SQL, not a short line that ends three of its turns."""
    import duckdb

    from vellumine.plans.queries import oracle_sql, pdf_multipage_roundtrip

    rows = [(c, t, "user", f"What is said in turn {t}.\nThe end.") for c in range(2) for t in range(2 + 2 * c)]
    rows += [(2, t, "user", text) for t, text in enumerate(["", "The end.", "The end.", None, "More text.\n\nThe end."])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, pdf_multipage_roundtrip(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(oracle_sql()["pdf_multipage_roundtrip"]).fetchall())
    assert [m.count("The end.") for _, m in got] == [2, 4, 3]

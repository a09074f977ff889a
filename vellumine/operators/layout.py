"""Layout of spans as DataFrame operations.

All take ``keys``, the columns that name a page or a document. Windows and
groups over a page's keys can use one partitioning by the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.lines import trim
from vellumine.kernel import layout as kernel
from vellumine.kernel.content import Span

BINS = 24
#: Height of the band at the top or bottom of a page, and how near a span must be to a dropped line.
BAND, NEAR = 6.0, 2.0
#: Bytes of spans, as the plan estimates them from compressed files, that one task sorts; no estimate goes beyond the second.
PART, UNKNOWN = 4 << 20, 1 << 50


#: Documents whose spans Python holds at a time.
SLICE = 200


def estimated(df: DataFrame) -> int | None:
    """Bytes of a table by its plan; None if the plan doesn't know."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size if size < UNKNOWN else None


def parted(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by ``keys`` in parts that grow in number, not in size; what Spark would join to larger ones stays apart."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(-(-(estimated(df) or 0) // PART), 100_000)), *keys)


def text_layout(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Spans of plain text: each line that isn't blank is a span of 12 points, 14 below the last, a blank line leaves 24."""
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line")).withColumn("text", trim(F.col("line")))
    step = F.when(F.col("text") == "", F.lit(24)).otherwise(F.lit(14))
    above = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("y", (F.lit(1000) - F.coalesce(F.sum(step).over(above), F.lit(0))).cast("float"))
    return placed.where("text <> ''").select(
        *keys, F.col("n").alias("seq"), "text", F.lit(0.0).cast("float").alias("x"), "y", (F.octet_length("text") * 6).cast("float").alias("width"),
        *(F.lit(12.0).cast("float").alias(c) for c in ("height", "font_size")), *(F.lit(False).alias(c) for c in ("bold", "italic", "mono")),
        F.lit("text").alias("kind"), F.lit(None).cast("bigint").alias("mcid"), F.lit(False).alias("space_before"),
    )


def concat_spans(items: Column) -> Column:
    """Text of an array of structs with text and space_before, in order."""

    def step(out: Column, s: Column) -> Column:
        gap = F.when(s["space_before"] & (out != "") & ~out.endswith(" "), F.lit(" ")).otherwise(F.lit(""))
        return F.concat(out, gap, s["text"])

    return F.aggregate(items, F.lit(""), step)


def running_margins(spans: DataFrame, doc: list[str], page: str = "page_idx") -> DataFrame:
    """(doc, text) of what tops or ends at least three pages of a document of three pages or more; only a band of each page is gathered."""
    by_page = Window.partitionBy(*doc, page)
    own = spans.where("kind = 'text'").select(*doc, page, "seq", "x", "y", "text", "space_before").withColumn("top", F.max("y").over(by_page)).withColumn("bottom", F.min("y").over(by_page))
    item = F.struct("x", "seq", "text", "space_before")

    def band(edge: str, side: str) -> DataFrame:
        near = own.where(F.abs(F.col("y") - F.col(edge)) < F.lit(BAND).cast("float"))
        text = trim(concat_spans(F.array_sort(F.collect_list(item))))
        return near.groupBy(*doc, page).agg(text.alias("text")).withColumn("side", F.lit(side))

    bands = band("top", "top").unionByName(band("bottom", "bottom")).where("text <> '' AND octet_length(text) < 80")
    return bands.groupBy(*doc, "side", "text").count().where("count >= 3").select(*doc, "text").distinct()


def strip_margins(spans: DataFrame, margins: DataFrame, doc: list[str], page: str = "page_idx") -> DataFrame:
    """Spans without those near a line whose text is a margin of the document; images stay."""
    lines = visual_lines(spans, [*doc, page])
    drop = lines.join(margins, [*doc, "text"], "left_semi").select(*doc, page, F.col("y").alias("drop_y"))
    near = [spans[c] == drop[c] for c in (*doc, page)] + [F.abs(spans["y"] - drop["drop_y"]) <= F.lit(NEAR).cast("float"), spans["kind"] != "image"]
    return spans.join(drop, near, "left_anti")


def visual_lines(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, y, spans, text): a line takes spans, from top to bottom, while they are near the height of its first one.

    A span that isn't near the one above it starts a line in any case; only what
    lies between two such is folded span by span.
    """
    spans = parted(spans, keys)
    # order inside a line: by x, then as the lines were read, from the top
    fields = ["x", "down", "seq", "y", "font_size", "text", "kind", "space_before"]
    near = F.greatest((F.col("font_size") * F.lit(0.45).cast("float")).cast("float"), F.lit(2.0).cast("float"))
    spans = spans.withColumn("down", -F.col("y")).withColumn("near", near)
    above = F.lag("y").over(Window.partitionBy(*keys).orderBy("down", *fields))
    spans = islands(spans, keys, ["down", *fields], ~(F.abs(above - F.col("y")) < F.col("near")), "run")
    item = F.struct(*(F.col(c) for c in fields))
    page = spans.groupBy(*keys, "run").agg(F.collect_list(F.struct(F.col("down").alias("first"), *fields, "near")).alias("all"))
    kind = f"array<struct<y: float, spans: array<{spans.select(item.alias('s')).schema['s'].dataType.simpleString()}>>>"

    def step(out: Column, s: Column) -> Column:
        plain = F.struct(*(s[c].alias(c) for c in fields))
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["y"].alias("y"), F.concat(last["spans"], F.array(plain)).alias("spans"))))
        return F.when(F.abs(last["y"] - s["y"]) < s["near"], grown).otherwise(F.concat(out, F.array(F.struct(s["y"].alias("y"), F.array(plain).alias("spans")))))

    folded = page.select(*keys, "run", F.aggregate(F.array_sort("all"), F.array().cast(kind), step).alias("lines"))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("run", "at")) - 1).alias("line")
    lines = folded.select(*keys, "run", F.posexplode("lines").alias("at", "l")).select(*keys, number, "l.y", F.array_sort("l.spans").alias("spans"))
    return lines.withColumn("text", trim(concat_spans(F.filter("spans", lambda s: s["kind"] != "image"))))


def x_histogram(spans: DataFrame, keys: list[str], x: str = "x", bins: int = BINS) -> DataFrame:
    """(keys, bin, n) of left edges between the least and the greatest of a page."""
    own = Window.partitionBy(*keys)
    low, high = F.min(x).over(own), F.max(x).over(own)
    place = F.least(F.floor((F.col(x) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0)) * bins), F.lit(bins - 1))
    return spans.where(F.col(x).isNotNull()).select(*keys, x, low.alias("low"), high.alias("high")).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def column_gaps(spans: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, gaps): up to two x between columns, from runs of nearly empty bins with a fifth of the spans on either side."""
    hist = x_histogram(spans, keys, x).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    ranges = spans.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("total"))
    full = hist.join(ranges, keys).withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.element_at("h", i), F.lit(0))))
    few = F.greatest(F.floor(F.col("total") / 40), F.lit(2))
    empty = F.transform(F.sequence(F.lit(1), F.lit(BINS - 2)), lambda i: F.struct(i.alias("i"), (F.get("h", i) <= few).alias("empty")))
    runs = F.aggregate(
        empty,
        F.array().cast("array<struct<a: int, b: int>>"),
        lambda out, s: F.when(~s["empty"], out)
        .when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] == s["i"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.try_element_at(out, F.lit(-1))["a"].alias("a"), (s["i"] + 1).alias("b")))))
        .otherwise(F.concat(out, F.array(F.struct(s["i"].alias("a"), (s["i"] + 1).alias("b"))))),
    )
    share = lambda lo, n: F.aggregate(F.slice("h", lo, n), F.lit(0).cast("long"), lambda a, v: a + v) * 5 >= F.col("total")
    good = F.filter(runs, lambda r: (r["b"] - r["a"] >= 2) & share(F.lit(1), r["a"]) & share(r["b"] + 1, F.lit(BINS) - r["b"]))
    gaps = F.transform(F.slice(good, 1, 2), lambda r: F.col("low") + (F.col("high") - F.col("low")) * (r["a"] + F.floor((r["b"] - r["a"]) / 2) + 0.5) / BINS)
    return full.select(*keys, F.when((F.col("total") >= 8) & (F.col("high") - F.col("low") >= 180), gaps).otherwise(F.array().cast("array<double>")).alias("gaps"))


def column_of(x: Column, gaps: Column) -> Column:
    return F.size(F.filter(gaps, lambda g: x >= g))


def weighted_median(df: DataFrame, keys: list[str], size: str, weight: str, default: float = 12.0) -> DataFrame:
    """(keys, median): the least size at which half of the weight is reached; sizes are first summed, so the window sees each once."""
    summed = df.groupBy(*keys, size).agg(F.sum(F.when(F.col(size) > 0.1, F.greatest(F.col(weight), F.lit(1)))).alias("w"))
    upto = Window.partitionBy(*keys).orderBy(size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = summed.withColumn("sofar", F.sum("w").over(upto)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
    return half.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("sofar") * 2 >= F.col("all"), F.col(size))), F.lit(default)).alias("median"))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "block") -> DataFrame:
    """Numbers runs of rows; ``breaks`` tells where one starts and may use ``lag`` over ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__b")


def block_breaks(keys: list[str]) -> Column:
    """Whether a line (y, font_size, seq) starts a block: it is more than one and a half times its size below the last."""
    before = F.lag("y").over(Window.partitionBy(*keys).orderBy("seq"))
    return F.abs(before - F.col("y")) > F.greatest(F.col("font_size"), F.lit(12.0).cast("float")) * 1.5


def cluster_edges(values: Column, eps: float = kernel.EPS) -> Column:
    """Means of runs of sorted values, each within ``eps`` of the mean of its run so far."""
    empty = F.array().cast("array<struct<total: double, n: int>>")

    def step(out: Column, v: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = v - last["total"] / last["n"] <= eps
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct((last["total"] + v).alias("total"), (last["n"] + 1).alias("n"))))
        return F.when(joins, grown).otherwise(F.concat(out, F.array(F.struct(v.cast("double").alias("total"), F.lit(1).alias("n")))))

    return F.aggregate(F.array_sort(values), empty, step, lambda out: F.transform(out, lambda r: r["total"] / r["n"]))


def cell_of(x: Column, edges: Column) -> Column:
    """Number of the cell between sorted ``edges`` that has ``x``; null outside."""
    n = F.size(F.filter(edges, lambda e: e <= x))
    return F.when((n > 0) & (n < F.size(edges)), n - 1)


def cells_by_range(spans: DataFrame, edges: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Spans with the cell (lo, hi, cell) that holds ``x``; cells are joined by keys and range."""
    on = [spans[k] == edges[k] for k in keys] + [spans[x] >= edges["lo"], spans[x] < edges["hi"]]
    return spans.join(edges, on, "inner").select(spans["*"], edges["cell"])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; also how the newest of several cross-reference entries is taken."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def number_images(df: DataFrame, doc: list[str], order: list[str], ext: str = "ext") -> DataFrame:
    """Columns img_no and filename, counted in each document."""
    n = F.row_number().over(Window.partitionBy(*doc).orderBy(*order))
    return df.withColumn("img_no", n).withColumn("filename", F.format_string("img-%03d.%s", "img_no", ext))


def spans_of(lists: pa.ListArray) -> Iterator[list[tuple[int, Span]]]:
    """(page_idx, span) of each list of structs, read field by field; what isn't null is in each struct."""
    f = dict(zip((x.name for x in lists.type.value_type), lists.flatten().flatten()))
    text, kind, *flags = (f[n].to_pylist() for n in ("text", "kind", "bold", "italic", "mono", "space_before"))
    bold, italic, mono, space = (map(bool, x) for x in flags)
    rest = (f[n].to_pylist() for n in ("x", "y", "width", "height", "font_size"))
    own = map(Span, (t or "" for t in text), *rest, bold, italic, mono, (k == "image" for k in kind), f["mcid"].to_pylist(), space)
    both = zip(f["page_idx"].to_pylist(), own)
    return ([*islice(both, n or 0)] for n in lists.value_lengths().to_pylist())


def format_spans(spans: DataFrame, rects: DataFrame | None = None, roles: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, page_idx, markdown) of tables of spans, rectangles and roles, by the same formatter as the converter.

    A document's rows meet in one task. Rows with a null doc or page_idx are left
    out; repeated spans are painted twice. Pages without spans give no row.
    """
    span = ["text", "x", "y", "width", "height", "font_size", "bold", "italic", "mono", "kind", "mcid", "space_before"]
    page = spans.where(F.col(doc).isNotNull() & F.col("page_idx").isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_idx", "seq", *span))).alias("spans"))
    if rects is not None:
        page = page.join(rects.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_idx", "seq", "x", "y", "w", "h"))).alias("rects")), doc, "left")
    if roles is not None:
        page = page.join(roles.groupBy(doc).agg(F.collect_list(F.struct("page_idx", "mcid", "kind", "level")).alias("roles")), doc, "left")
    schema = f"{doc} {spans.schema[doc].dataType.simpleString()}, page_idx int, markdown string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            out, each = [], spans_of(batch.column("spans"))
            for row, own in zip(batch.drop_columns("spans").to_pylist(), each):
                pages: dict[int, tuple[list, list]] = {}
                for page_idx, s in own:
                    pages.setdefault(page_idx, ([], []))[0].append(s)
                for r in row.get("rects") or ():
                    if r["page_idx"] in pages:
                        pages[r["page_idx"]][1].append((r["x"], r["y"], r["w"], r["h"]))
                known: dict = {}
                for r in row.get("roles") or ():
                    known.setdefault((r["page_idx"], r["mcid"]), (r["kind"], r["level"]))
                margins = kernel.running_margins([p[0] for p in pages.values()])
                out += [(row[doc], i, kernel.format_page(*pages[i], known, i, margins)) for i in sorted(pages)]
            if out:
                ids, numbers, texts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(doc).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[doc, "page_idx", "markdown"])

    return page.mapInArrow(run, schema)

"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import base64
import tempfile
import uuid
import zlib
from codecs import encode as rot13
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import codecs
from vellumine.functions import lines as L
from vellumine.functions import markdown as M
from vellumine.operators import decode, layout, text
from vellumine.plans import api
from vellumine.plans.metrics import token_quality
from vellumine.sources import files, sinks
from vellumine.sources.storage import make_folder
from vellumine.testing import pdf_builder as B

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ text


def _decorated(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): documents, with headings, list items and hyphens put in by line number; what follows a heading or a hyphen goes on in a line of its own."""

    def line(x: Column, i: Column) -> Column:
        k = i % 7
        rest = lambda n: F.substring(x, F.lit(n + 1), F.char_length(x))
        return (
            F.when(k == 1, F.concat(F.lit("\n"), F.translate(F.substring(x, 1, 40), LOWER, UPPER), F.lit("\n"), rest(40)))
            .when(k == 2, F.concat(F.lit("• "), x))
            .when(k == 3, F.concat(F.lit("3) "), x, F.lit("\n")))
            .when(k == 4, F.concat(F.substring(x, 1, 20), F.lit("-"), F.when(rest(20) != "", F.concat(F.lit("\n"), rest(20))).otherwise("")))
            .when(k == 6, F.concat(F.lit("\n1.2 "), F.substring(x, 1, 30), F.lit("\n"), rest(30)))
            .otherwise(x)
        )

    docs = _table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


_NUM, _BUL, _ORD = rf"^([0-9]+(?:\.[0-9]+)*)\.?[{WS}]+", rf"^[-*•◦▪‣⁃][{WS}]+", rf"^([0-9]+)[.)][{WS}]+"

SQL_DECORATED = f"""d0 AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d1 AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d0),
decorated AS (SELECT doc_id, string_agg(CASE i % 7
  WHEN 1 THEN chr(10) || translate(left(x, 40), '{LOWER}', '{UPPER}') || chr(10) || substr(x, 41)
  WHEN 2 THEN '• ' || x WHEN 3 THEN '3) ' || x || chr(10) WHEN 4 THEN left(x, 20) || '-' || CASE WHEN length(x) > 20 THEN chr(10) || substr(x, 21) ELSE '' END
  WHEN 6 THEN chr(10) || '1.2 ' || left(x, 30) || chr(10) || substr(x, 31) ELSE x END, chr(10) ORDER BY i) AS text FROM d1 GROUP BY doc_id)"""


def _sql_lines(source: str, keys: str = "doc_id") -> str:
    """CTEs up to ``lines``: keys, n, block, line (trimmed, not blank) and its shapes."""
    return f"""s0 AS (SELECT {keys}, string_split(text, chr(10)) AS l FROM {source}),
s1 AS (SELECT {keys}, unnest(l) AS raw, generate_subscripts(l, 1) AS n FROM s0),
s2 AS (SELECT {keys}, n, {_trim("raw")} AS line FROM s1),
s3 AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY n) AS block FROM s2),
s4 AS (SELECT *, strlen(line) <= 120 AND NOT ends_with(line, '.') AND NOT ends_with(line, ',') AS shaped,
  len(list_filter(regexp_split_to_array(line, '[{WS}]+'), lambda w: w <> '')) AS words, regexp_matches(line, '{_NUM}') AS numbered FROM s3 WHERE line <> ''),
s5 AS (SELECT *, shaped AND regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AND words <= 12 AS all_caps,
  shaped AND strlen(line) <= 80 AND words <= 10 AS short_title,
  CASE line WHEN 'Abstract' THEN 3 WHEN 'Introduction' THEN 1 WHEN 'References' THEN 2 WHEN 'Bibliography' THEN 2 WHEN 'Conclusion' THEN 2 WHEN 'Conclusions' THEN 2
    WHEN 'Acknowledgements' THEN 2 WHEN 'Acknowledgments' THEN 2 WHEN 'Related Work' THEN 2 WHEN 'Related Works' THEN 2 END AS section,
  CASE WHEN regexp_matches(line, '{_BUL}') THEN '- ' || {_trim(f"regexp_replace(line, '{_BUL}', '')")}
    WHEN regexp_matches(line, '{_ORD}') THEN regexp_extract(line, '{_ORD}', 1) || '. ' || {_trim(f"regexp_replace(line, '{_ORD}', '')")} END AS item FROM s4),
lines AS (SELECT *, CASE WHEN NOT shaped THEN NULL WHEN numbered THEN least(length(regexp_replace(regexp_extract(line, '{_NUM}', 1), '[0-9]', '', 'g')) + 1, 6)
  WHEN all_caps THEN 2 WHEN short_title AND regexp_matches(line, '^\\p{{Lu}}') AND NOT contains(line, ';') THEN 3 END AS level,
  regexp_replace(line, '{_NUM}', '') AS bare FROM s5)"""


def _sql_pages(keys: str = "doc_id") -> str:
    """CTE ``pages``: keys, md, from ``lines``."""
    return f"""b0 AS (SELECT {keys}, block, count(*) AS k, bool_and(item IS NOT NULL) AS listed, string_agg(item, chr(10) ORDER BY n) AS items,
  replace(regexp_replace(string_agg(line, chr(2) ORDER BY n), '-' || chr(2) || '(\\p{{Ll}})', '\\1', 'g'), chr(2), ' ') AS para,
  max(CASE WHEN numbered THEN level ELSE coalesce(section, CASE WHEN all_caps THEN 2 END) END) AS level, max(bare) AS bare FROM lines GROUP BY {keys}, block),
pages AS (SELECT {keys}, string_agg(CASE WHEN listed THEN items WHEN k = 1 AND level IS NOT NULL THEN repeat('#', level) || ' ' || bare ELSE para END, chr(10) || chr(10) ORDER BY block) AS md FROM b0 GROUP BY {keys})"""


def _sql_title(md: str) -> str:
    """Title and last line end of ``md``, which starts with no white space."""
    head = f"split_part({md}, chr(10) || chr(10), 1)"
    return f"CASE WHEN {md} = '' OR starts_with({md}, '#') OR starts_with({md}, '![') OR contains({head}, chr(10)) THEN {md} ELSE '# ' || {md} END || chr(10)"


def text_to_markdown(spark, sf):
    return text.finish(_decorated(spark, sf), F.array(text.text_page(F.col("text")))).select("doc_id", "markdown")


SQL_TEXT_TO_MARKDOWN = f"""WITH {SQL_DECORATED}, {_sql_lines("decorated")}, {_sql_pages()}
SELECT doc_id, {_sql_title("coalesce(md, '')")} AS markdown FROM decorated LEFT JOIN pages USING (doc_id)"""


def _lines(spark, sf):
    rows = _decorated(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), L.trim(F.col("line")).alias("line")).where("line <> ''")


def _line_query(made: Callable[[Column], dict[str, Column]], keep: Callable[[Column], Column] | None, sql_columns: str, sql_where: str):
    def run(spark, sf):
        rows, c = _lines(spark, sf), F.col("line")
        rows = rows.where(keep(c)) if keep else rows
        return rows.select("doc_id", "n", "line", *(v.alias(k) for k, v in made(c).items()))

    return run, f"WITH {SQL_DECORATED}, {_sql_lines('decorated')} SELECT doc_id, n - 1 AS n, line{sql_columns} FROM lines{sql_where}"


def conversation_layout(spark, sf) -> DataFrame:
    """Conversations as documents: a turn is a page that starts with its speaker's name."""
    conv = _table(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    page = F.concat(F.lit("Said by "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return layout.text_layout(conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_idx"), page.alias("text")), ["doc_id", "page_idx"])


SQL_CONV = f"""c0 AS (SELECT conv_id AS doc_id, turn AS page_idx, string_split('Said by ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10)) AS l FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c1 AS (SELECT doc_id, page_idx, unnest(l) AS raw, generate_subscripts(l, 1) AS n FROM c0),
cl AS (SELECT doc_id, page_idx, n, {_trim("raw")} AS line FROM c1),
cs AS (SELECT * FROM cl WHERE line <> ''),
edge AS (SELECT DISTINCT doc_id, page_idx, 'top' AS side, first_value(line) OVER (PARTITION BY doc_id, page_idx ORDER BY n) AS text FROM cs
  UNION ALL SELECT DISTINCT doc_id, page_idx, 'bottom', first_value(line) OVER (PARTITION BY doc_id, page_idx ORDER BY n DESC) FROM cs),
margins AS (SELECT DISTINCT doc_id, text FROM (SELECT doc_id, side, text FROM edge WHERE strlen(text) < 80 GROUP BY doc_id, side, text HAVING count(*) >= 3))"""


def running_margins(spark, sf):
    return layout.running_margins(conversation_layout(spark, sf), ["doc_id"])


def strip_running_margins(spark, sf):
    spans = conversation_layout(spark, sf)
    out = layout.strip_margins(spans, layout.running_margins(spans, ["doc_id"]), ["doc_id"])
    return out.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.col("seq").cast("long").alias("seq"), "text")


def _page_join(breaks: bool):
    def run(spark, sf):
        conv = _table(spark, sf, "conversations").where("conv_id IS NOT NULL")
        pages = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
        return pages.select("conv_id", M.join_pages(F.col("p.text"), breaks).alias("markdown"))

    joint = "chr(10) || chr(10) || '---' || chr(10) || chr(10)" if breaks else "chr(10) || chr(10)"
    return run, f"SELECT conv_id, coalesce(string_agg(text, {joint} ORDER BY turn, text) FILTER (WHERE {_trim('text')} <> ''), '') AS markdown FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"


def title_and_end(spark, sf):
    docs = _table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.select("doc_id", M.end_line(M.promote_title(F.replace("text", F.lit(".\n"), F.lit(".\n\n")))).alias("markdown"))


SQL_TITLE = f"""WITH t AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS m FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, m, regexp_replace(m, '^[{WS}]+', '') AS body FROM t),
v AS (SELECT *, split_part(body, chr(10) || chr(10), 1) AS head, {_trim("split_part(body, chr(10) || chr(10), 1)")} AS title FROM u),
w AS (SELECT doc_id, CASE WHEN title = '' OR starts_with(body, '#') OR starts_with(body, '![') OR contains(title, chr(10)) THEN m
  ELSE left(m, length(m) - length(body)) || '# ' || title || substr(body, length(head) + 1) END AS m FROM v)
SELECT doc_id, CASE WHEN ends_with(m, chr(10)) THEN m ELSE m || chr(10) END AS markdown FROM w"""


def dehyphenate_paragraphs(spark, sf):
    docs = _table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    halves = F.transform(F.split("text", "\n"), lambda x: L.trim(F.regexp_replace(x, r"\.$", "-")))
    return docs.select("doc_id", M.join_paragraph(F.filter(halves, lambda x: x != "")).alias("paragraph"))


SQL_DEHYPHENATE = f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM a),
c AS (SELECT doc_id, n, {_trim("regexp_replace(x, '\\.$', '-')")} AS x FROM b)
SELECT doc_id, coalesce(replace(regexp_replace(string_agg(x, chr(2) ORDER BY n) FILTER (WHERE x <> ''), '-' || chr(2) || '(\\p{{Ll}})', '\\1', 'g'), chr(2), ' '), '') AS paragraph FROM c GROUP BY doc_id"""


# ------------------------------------------------------------------ geometry and relations


def font_style_sniff(spark, sf):
    part = _table(spark, sf, "part")
    name = F.concat_ws("-", "p_name", F.element_at(F.array(*map(F.lit, ("Bold", "Oblique", "CourierNew", "HeavyItalic", "Menlo", "Roman"))), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int")))
    return part.where("p_partkey IS NOT NULL").select("p_partkey", name.alias("font")).select("p_partkey", "font", L.font_style(F.col("font")).alias("s")).select("p_partkey", "font", "s.*")


SQL_STYLE = """WITH f AS (SELECT p_partkey, concat_ws('-', p_name, list_extract(['Bold', 'Oblique', 'CourierNew', 'HeavyItalic', 'Menlo', 'Roman'], p_partkey % 6 + 1)) AS font FROM part WHERE p_partkey IS NOT NULL)
SELECT p_partkey, font, regexp_matches(lower(font), 'bold|black|heavy') AS bold, regexp_matches(lower(font), 'italic|oblique') AS italic,
  regexp_matches(lower(font), 'courier|mono|consolas|menlo|monaco|lucidaconsole') AS mono FROM f"""


def emphasis_spans(spark, sf):
    part = _table(spark, sf, "part").where("p_name IS NOT NULL")
    return part.select("p_partkey", L.emphasis(F.col("p_name"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("styled"))


SQL_EMPHASIS = f"""SELECT p_partkey, w || p_name || w AS styled FROM (SELECT p_partkey, p_name, CASE WHEN {_trim("p_name")} = '' THEN ''
  ELSE (CASE WHEN p_size % 2 = 0 THEN '**' ELSE '' END) || (CASE WHEN p_size % 3 = 0 THEN '*' ELSE '' END) END AS w FROM part WHERE p_name IS NOT NULL)"""


def weighted_median_size(spark, sf):
    return layout.weighted_median(_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_linenumber")


SQL_MEDIAN = """WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity AS q, sum(greatest(l_linenumber, 1)) AS w FROM lineitem WHERE l_quantity > 0.1 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY q) AS sofar, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM s)
SELECT l_returnflag, l_linestatus, min(q) FILTER (WHERE sofar * 2 >= total) AS median FROM c GROUP BY ALL"""


def x_histogram(spark, sf):
    return layout.x_histogram(_table(spark, sf, "events"), ["event_type"], "value").select("event_type", "bin", "n")


_HIST = """r AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS low, max(value) OVER (PARTITION BY event_type) AS high FROM events WHERE value IS NOT NULL),
h AS (SELECT event_type, CAST(least(floor((value - low) / greatest(high - low, 1.0) * 24), 23) AS INT) AS bin, count(*) AS n FROM r GROUP BY ALL)"""
SQL_HISTOGRAM = f"WITH {_HIST} SELECT event_type, bin, n FROM h"


def column_gaps(spark, sf):
    """Orders of each priority as left edges of text in two columns."""
    x = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 50).otherwise(400 + F.col("o_custkey") % 50).cast("double")
    gaps = layout.column_gaps(_table(spark, sf, "orders").where("o_custkey IS NOT NULL").select("o_orderpriority", x.alias("x")), ["o_orderpriority"])
    return gaps.select("o_orderpriority", F.size("gaps").alias("n_gaps"), F.round(F.get("gaps", F.lit(0)), 6).alias("first_gap"))


SQL_GAPS = """WITH s AS (SELECT o_orderpriority AS k, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 ELSE 400 + o_custkey % 50 END AS DOUBLE) AS x FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT k, min(x) AS low, max(x) AS high, count(*) AS total FROM s GROUP BY k),
h AS (SELECT k, CAST(least(floor((x - low) / (high - low) * 24), 23) AS INT) AS bin, count(*) AS n FROM s JOIN r USING (k) GROUP BY ALL),
f AS (SELECT r.k, low, high, total, i, coalesce(n, 0) AS n FROM r, range(24) AS t(i) LEFT JOIN h ON h.k = r.k AND h.bin = i),
e AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS run FROM f WHERE i BETWEEN 1 AND 22 AND n <= greatest(total // 40, 2)),
g AS (SELECT k, low, high, total, min(i) AS a, max(i) + 1 AS b FROM e GROUP BY k, low, high, total, run HAVING count(*) >= 2),
ok AS (SELECT *, low + (high - low) * (a + (b - a) // 2 + 0.5) / 24 AS gap FROM g
  WHERE (SELECT sum(n) FROM f WHERE f.k = g.k AND f.i < a) * 5 >= total AND (SELECT sum(n) FROM f WHERE f.k = g.k AND f.i >= b) * 5 >= total)
SELECT r.k AS o_orderpriority, CAST(least(count(a), 2) AS INT) AS n_gaps, round(min(gap), 6) AS first_gap FROM r LEFT JOIN ok ON ok.k = r.k GROUP BY r.k"""


def line_islands(spark, sf):
    events = _table(spark, sf, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return layout.islands(events, ["user_id"], ["ts", "event_id"], F.unix_timestamp("ts") - F.unix_timestamp(before) > 3600).select("event_id", "user_id", "block")


SQL_ISLANDS = """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 3600 THEN 1 ELSE 0 END AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS block FROM e"""


def visual_lines(spark, sf):
    """Line items as spans of their order: quantity is the height, line number the left edge."""
    li = _table(spark, sf, "lineitem").where("l_orderkey IS NOT NULL")
    spans = li.select("l_orderkey", F.col("l_linenumber").alias("seq"), F.col("l_linenumber").cast("float").alias("x"), F.col("l_quantity").cast("float").alias("y"), F.lit(12.0).cast("float").alias("font_size"), F.col("l_returnflag").alias("text"), F.lit("text").alias("kind"), F.lit(True).alias("space_before"))
    return layout.visual_lines(spans, ["l_orderkey"]).select("l_orderkey", F.col("line").cast("long").alias("line"), F.col("y").cast("double").alias("y"), "text")


SQL_VISUAL = """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber AS x, l_quantity AS y, l_returnflag AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_returnflag) AS n FROM lineitem WHERE l_orderkey IS NOT NULL),
f AS (SELECT l_orderkey, x, y, t, n, y AS top, 0 AS line FROM o WHERE n = 1
  UNION ALL SELECT o.l_orderkey, o.x, o.y, o.t, o.n, CASE WHEN abs(f.top - o.y) < 5.4 THEN f.top ELSE o.y END, CASE WHEN abs(f.top - o.y) < 5.4 THEN f.line ELSE f.line + 1 END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
SELECT l_orderkey, CAST(line AS BIGINT) AS line, CAST(min(top) AS DOUBLE) AS y, string_agg(t, ' ' ORDER BY x, y DESC, t) AS text FROM f GROUP BY l_orderkey, line"""


def cluster_edges(spark, sf):
    part = _table(spark, sf, "part").groupBy("p_brand").agg(F.collect_list((F.col("p_size") * 2).cast("double")).alias("v"))
    return part.select("p_brand", F.posexplode(layout.cluster_edges(F.col("v"))).alias("i", "edge")).select("p_brand", F.col("i").cast("long").alias("i"), F.round("edge", 6).alias("edge"))


SQL_CLUSTER = """WITH RECURSIVE o AS (SELECT p_brand, CAST(p_size * 2 AS DOUBLE) AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part WHERE p_size IS NOT NULL),
f AS (SELECT p_brand, v, n, v AS total, 1 AS k, 0 AS i FROM o WHERE n = 1
  UNION ALL SELECT o.p_brand, o.v, o.n, CASE WHEN o.v - f.total / f.k <= 3 THEN f.total + o.v ELSE o.v END, CASE WHEN o.v - f.total / f.k <= 3 THEN f.k + 1 ELSE 1 END, CASE WHEN o.v - f.total / f.k <= 3 THEN f.i ELSE f.i + 1 END
  FROM f JOIN o ON o.p_brand IS NOT DISTINCT FROM f.p_brand AND o.n = f.n + 1)
SELECT p_brand, CAST(i AS BIGINT) AS i, round(arg_max(total / k, n), 6) AS edge FROM f GROUP BY p_brand, i"""


def span_to_cell(spark, sf):
    """Line items in cells of their price, by the bounds that each ship status has."""
    li = _table(spark, sf, "lineitem").where("l_extendedprice IS NOT NULL").select("l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice")
    bounds = li.groupBy("l_linestatus").agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b"))
    step = (F.col("b") - F.col("a")) / 8
    edges = bounds.select("l_linestatus", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cell"), "a", step.alias("s")).select("l_linestatus", "cell", (F.col("a") + F.col("s") * F.col("cell")).alias("lo"), (F.col("a") + F.col("s") * (F.col("cell") + 1)).alias("hi"))
    cells = layout.cells_by_range(li, F.broadcast(edges), "l_extendedprice", ["l_linestatus"])
    return cells.groupBy("l_linestatus", "cell").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("most"))


SQL_CELLS = """WITH b AS (SELECT l_linestatus, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY 1),
e AS (SELECT l_linestatus, CAST(i AS INT) AS cell, a + (b - a) / 8 * i AS lo, a + (b - a) / 8 * (i + 1) AS hi FROM b, range(8) AS t(i))
SELECT l_linestatus, cell, count(*) AS n, max(l_extendedprice) AS most FROM lineitem JOIN e USING (l_linestatus) WHERE l_extendedprice >= lo AND l_extendedprice < hi GROUP BY 1, 2"""


def gfm_tables(spark, sf):
    rows = _table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("Key"), F.lit("Name | short"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select("n_regionkey", M.gfm_table(cells).alias("markdown"))


SQL_GFM = r"""SELECT n_regionkey, '| Key | Name \| short |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || trim(replace(n_name, '|', '\|')) || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey"""


def image_numbering(spark, sf):
    pages = _table(spark, sf, "pages").where("page_id IS NOT NULL AND url IS NOT NULL")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)
    rows = pages.select("page_id", host.alias("doc"), F.when(F.col("page_id") % 2 == 0, "png").otherwise("jpg").alias("ext"))
    return layout.number_images(rows, ["doc"], ["page_id"]).select("page_id", "doc", "img_no", "filename")


SQL_NUMBERING = r"""WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS doc, CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_id) AS k FROM r)
SELECT page_id, doc, CAST(k AS INT) AS img_no, format('img-{:03d}.{}', k, ext) AS filename FROM n"""


def image_links(spark, sf):
    pages = _table(spark, sf, "pages").where("url IS NOT NULL")
    mark = F.lit(M.MARK)
    text_ = F.concat(F.lit("see "), mark, F.concat(F.lit("img-"), F.col("page_id").cast("string"), F.lit(".png")), mark, F.lit(" and "), F.col("url"), F.when(F.col("page_id") % 3 == 0, mark).otherwise(F.lit("")))
    return pages.select("page_id", M.link_images(text_, "figs$1/").alias("markdown"))


SQL_LINKS = "SELECT page_id, 'see ![](figs$1/img-' || page_id || '.png) and ' || url || CASE WHEN page_id % 3 = 0 THEN chr(1) ELSE '' END AS markdown FROM pages WHERE url IS NOT NULL"


def role_first_wins(spark, sf):
    events = _table(spark, sf, "events").where("user_id IS NOT NULL")
    return layout.first_wins(events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


SQL_FIRST = "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id, event_type"


def xref_newest_wins(spark, sf):
    orders = _table(spark, sf, "orders").where("o_custkey IS NOT NULL")
    newest = layout.first_wins(orders.withColumn("back", -F.unix_timestamp("o_orderdate")), ["o_custkey"], ["back", "o_orderkey"])
    return newest.select("o_custkey", "o_orderkey")


SQL_NEWEST = "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(epoch(o_orderdate)) DESC, o_orderkey) AS n FROM orders WHERE o_custkey IS NOT NULL) WHERE n = 1"


def cmap_ranges(spark, sf):
    s = _table(spark, sf, "supplier").where("s_suppkey IS NOT NULL")
    low = F.col("s_suppkey").cast("int")
    return s.select("s_suppkey", F.explode(codecs.map_range(low, low + 4, F.lit("A"))).alias("m")).select("s_suppkey", "m.code", "m.text")


SQL_CMAP = "SELECT s_suppkey, CAST(s_suppkey + i AS INT) AS code, chr(CAST(65 + i AS INT)) AS text FROM supplier, range(5) AS t(i) WHERE s_suppkey IS NOT NULL"


def cmyk_to_rgb(spark, sf):
    part = _table(spark, sf, "part").where("p_partkey IS NOT NULL")
    c = [F.pmod(F.col("p_partkey") * k, F.lit(256)).cast("int") for k in (7, 13, 29, 3)]
    return part.select("p_partkey", codecs.cmyk_to_rgb(*c).alias("x")).select("p_partkey", "x.*")


SQL_CMYK = "SELECT p_partkey, " + ", ".join(f"CAST(255 - least(p_partkey * {k} % 256 + p_partkey * 3 % 256, 255) AS INT) AS {n}" for n, k in (("r", 7), ("g", 13), ("b", 29))) + " FROM part WHERE p_partkey IS NOT NULL"


def token_quality_by_role(spark, sf):
    conv = _table(spark, sf, "conversations").where("conv_id IS NOT NULL")
    return token_quality(conv.where("role = 'assistant'").select("conv_id", "text"), conv.where("role = 'user'").select("conv_id", "text"), "conv_id")


SQL_QUALITY = r"""WITH t AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM conversations WHERE conv_id IS NOT NULL AND role IN ('assistant', 'user')),
c AS (SELECT conv_id, w, count(*) FILTER (WHERE role = 'assistant') AS a, count(*) FILTER (WHERE role = 'user') AS b FROM t GROUP BY 1, 2),
s AS (SELECT conv_id, CAST(sum(a) AS BIGINT) AS found, CAST(sum(b) AS BIGINT) AS expected, CAST(sum(least(a, b)) AS BIGINT) AS common FROM c GROUP BY 1)
SELECT *, CASE WHEN expected > 0 THEN common / expected END AS recall, CASE WHEN found > 0 THEN common / found END AS precision, 2 * common / (found + expected) AS f1 FROM s"""


# ------------------------------------------------------------------ codecs


def _encoded(df: DataFrame, fn: Callable[[bytes], bytes], column: str = "text") -> Column:
    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return codecs.mapped(lambda t: fn(t.encode()), values)

    return run(column)


def _with_tags(raw: bytes, width: int = 16) -> bytes:
    """Rows of ``width`` bytes, predicted in turn by each of the five ways."""
    raw += b" " * (-len(raw) % width)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.int16)
    up, left, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    up[1:], left[:, 1:] = rows[:-1], rows[:, :-1]
    corner[1:, 1:] = rows[:-1, :-1]
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    tags = np.arange(len(rows)) % 5
    out = np.zeros((len(rows), width + 1), np.uint8)
    out[:, 0] = tags
    for tag, by in enumerate((np.zeros_like(rows), left, up, (left + up) // 2, nearest)):
        out[tag::5, 1:] = (rows[tag::5] - by[tag::5]) & 255
    return out.tobytes()


#: Bytes of the source, as the plan estimates them, that one task makes files of.
PART = 2 << 20


def dealt(df: DataFrame) -> DataFrame:
    """Rows for all cores and for tasks of some megabytes, whatever the partitions of the source.

    A row group is one task otherwise, and its rows fill the largest batches that
    Arrow makes of them.
    """
    size = layout.estimated(df) or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART), 100_000)))


def _documents(spark, sf):
    return _table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")


def flate_roundtrip(spark, sf):
    docs = _documents(spark, sf)
    return docs.select("doc_id", F.decode(codecs.flate(_encoded(docs, zlib.compress)), "UTF-8").alias("text"))


def flate_stored_roundtrip(spark, sf):
    """Blocks that are stored as they are."""
    docs = _documents(spark, sf)
    return docs.select("doc_id", F.decode(codecs.flate(_encoded(docs, lambda b: zlib.compress(b, 0))), "UTF-8").alias("text"))


def ascii85_roundtrip(spark, sf):
    docs = _documents(spark, sf)
    return docs.select("doc_id", F.decode(codecs.ascii85(_encoded(docs, lambda b: base64.a85encode(b, wrapcol=72) + b"~>")), "UTF-8").alias("text"))


def asciihex_roundtrip(spark, sf):
    return _documents(spark, sf).select("doc_id", F.decode(codecs.ascii_hex(F.concat(F.lit(" "), F.hex(F.encode("text", "UTF-8")), F.lit(">00"))), "UTF-8").alias("text"))


def predictor_roundtrip(spark, sf):
    docs = dealt(_documents(spark, sf))
    return docs.select("doc_id", F.hex(codecs.unpredict(_encoded(docs, _with_tags), 16)).alias("bytes"))


SQL_SAME = "SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"
SQL_PADDED = "SELECT doc_id, hex(encode(text)) || repeat('20', (16 - strlen(text) % 16) % 16) AS bytes FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"


# ------------------------------------------------------------------ whole files


def built(batches: Iterator[pa.RecordBatch], build: Callable[[object], bytes], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of the first column and of the file that ``build`` makes of the second; those of a batch are passed on by 200, or as they fill ``decode.FLUSH``."""
    for batch in batches:
        values, lo, made, size = batch.column(1), 0, [], 0
        for i in range(batch.num_rows):
            made.append(build(values[i].as_py()))
            size += len(made[-1])
            if size >= decode.FLUSH or len(made) == 200 or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(made)), pa.array(made, pa.binary())], names=[key, "content"])
                lo, made, size = i + 1, [], 0


def as_pdf(df: DataFrame, key: str, source: str, build: Callable[[object], bytes]) -> DataFrame:
    """(key, content) of a file that ``build`` makes from each value of ``source``.

    The rows are ``dealt`` first.
    """
    df = dealt(df.select(key, source))
    return df.mapInArrow(lambda batches: built(batches, build, key), f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def _split(t: str) -> list[str]:
    return [x.strip(" \t\r\x0b\x0c\x85\xa0") for x in t.split("\n")]


def _form_pdf(t: str) -> bytes:
    b = B.Builder()
    font = b.font()
    form = b.stream(B.text_content(_split(t)), b"/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Resources <</Font <</F1 %d 0 R>>>>" % font, flate=True)
    b.page(b"q /Fm1 Do Q", b"/XObject <</Fm1 %d 0 R>>" % form)
    return b.build()


def _pdf_query(build: Callable[[str], bytes]):
    def run(spark, sf):
        files = as_pdf(_decorated(spark, sf), "doc_id", "text", build)
        return decode.convert_documents(files).select("doc_id", "markdown")

    return run


#: Quotes as WinAnsi fonts show them; everything else of the documents comes back as it is.
_QUOTES = "replace(replace(replace({}, '''', '’'), '`', '‘'), chr(160), ' ')"
SQL_PDF = SQL_TEXT_TO_MARKDOWN.replace(" AS markdown FROM decorated", " AS m0 FROM decorated")
SQL_PDF = f"SELECT doc_id, {_QUOTES.format('m0')} AS markdown FROM ({SQL_PDF})"


def _paged_pdf(pages: list[str]) -> bytes:
    """A page for each text, with a blank foot: a short last line that three pages have in common would be a running one and go."""
    b = B.Builder()
    font = b.font()
    for lines in map(_split, pages):
        b.page(B.text_content(lines) + b"\nBT /F1 12 Tf 1 0 0 1 50 %d Tm ( ) Tj ET" % (600 - 24 * len(lines)), b"/Font <</F1 %d 0 R>>" % font)
    return b.build()


def pdf_multipage_roundtrip(spark, sf):
    """Conversations as files: a page for each turn, under a running head that goes from three pages on."""
    conv = _table(spark, sf, "conversations").where("conv_id IS NOT NULL")
    pages = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    source = pages.select("conv_id", F.transform("p", lambda x: F.concat(F.lit("Running head "), F.col("conv_id").cast("string"), F.lit("\n\n"), x["text"])).alias("pages"))
    files = as_pdf(source, "conv_id", "pages", _paged_pdf)
    return decode.convert_documents(files, page_breaks=True).select("conv_id", "markdown")


SQL_MULTIPAGE = f"""WITH t0 AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS page, count(*) OVER (PARTITION BY conv_id) AS n_pages FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, page, CASE WHEN n_pages < 3 THEN 'Running head ' || conv_id || chr(10) || chr(10) ELSE '' END || text AS text FROM t0),
{_sql_lines("t", "conv_id, page")}, {_sql_pages("conv_id, page")},
j AS (SELECT conv_id, string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS md FROM pages GROUP BY conv_id)
SELECT conv_id, {_QUOTES.format(_sql_title("coalesce(md, '')"))} AS markdown FROM (SELECT DISTINCT conv_id FROM t) LEFT JOIN j USING (conv_id)"""


def _tagged_pdf(t: str) -> bytes:
    """Each line is a block; the structure tree gives every second one a heading."""
    b, y = B.Builder(), 750.0
    font = b.font()
    content, kids = [b"BT /F1 12 Tf"], []
    lines = [x for x in _split(t) if x]
    for i, line in enumerate(lines):
        content.append(b"/P <</MCID %d>> BDC 1 0 0 1 50 %g Tm %s Tj EMC" % (i, y, B.literal(line)))
        y -= 40
        if i % 2:
            kids.append(b"<</S /H%d /K %d>>" % (1 + i % 6, i))
    page = b.page(b"\n".join([*content, b"ET"]), b"/Font <</F1 %d 0 R>>" % font)
    holders = [b.add(b"<</S /Sect /Pg %d 0 R /K [%s]>>" % (page, b" ".join(kids[i : i + 1000]))) for i in range(0, len(kids), 1000)]
    root = b.add(b"<</Type /StructTreeRoot /K [%s]>>" % b" ".join(b"%d 0 R" % h for h in holders))
    b.catalog_extra = b"/StructTreeRoot %d 0 R" % root
    return b.build()


def pdf_tagged_headings(spark, sf):
    files = as_pdf(_documents(spark, sf), "doc_id", "text", _tagged_pdf)
    return decode.convert_documents(files).select("doc_id", "markdown")


SQL_TAGGED = f"""WITH src AS ({SQL_SAME}), {_sql_lines("src")},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM lines),
b AS (SELECT doc_id, i, CASE WHEN item IS NOT NULL THEN item WHEN i % 2 = 1 THEN repeat('#', CAST(1 + i % 6 AS INT)) || ' ' || bare
  WHEN numbered AND level IS NOT NULL THEN repeat('#', level) || ' ' || bare WHEN NOT numbered AND section IS NOT NULL THEN repeat('#', section) || ' ' || bare WHEN NOT numbered AND all_caps THEN '## ' || bare ELSE line END AS md FROM k),
j AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY i) AS md FROM b GROUP BY doc_id)
SELECT doc_id, {_QUOTES.format(_sql_title("coalesce(md, '')"))} AS markdown FROM src LEFT JOIN j USING (doc_id)"""


def _raster(b: B.Builder, raw: bytes) -> int:
    """The bytes, filled up with spaces, as one row of RGB."""
    raw += b" " * (-len(raw) % 3 if raw else 3)
    return b.stream(raw, b"/Type /XObject /Subtype /Image /Width %d /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8" % (len(raw) // 3), flate=True)


def _image_pdf(v: dict) -> bytes:
    """The text as a JPEG's bytes, and for some documents as one or two rasters."""
    b = B.Builder()
    raw = v["text"].encode()
    names = [b.stream(raw, b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /Filter /DCTDecode"), *(_raster(b, raw) for _ in range(v["doc_id"] % 3))]
    b.page(b"\n".join(b"q 1 0 0 1 50 %d cm /Im%d Do Q" % (700 - 100 * i, n) for i, n in enumerate(names)), b"/XObject <<%s>>" % b" ".join(b"/Im%d %d 0 R" % (n, n) for n in names))
    return b.build()


def pdf_images(spark, sf):
    source = _documents(spark, sf).select("doc_id", F.struct("doc_id", "text").alias("v"))
    done = decode.convert_documents(as_pdf(source, "doc_id", "v", _image_pdf), image_dir="figs")
    return done.select("doc_id", "markdown", F.size("images").alias("n_images"), F.octet_length(F.get("images", F.lit(0))["bytes"]).cast("long").alias("first_size"))


SQL_IMAGES = """SELECT doc_id, '![](figs/img-001.jpg)' || CASE WHEN doc_id % 3 > 0 THEN chr(10) || chr(10) || '![](figs/img-002.png)' ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN chr(10) || chr(10) || '![](figs/img-003.png)' ELSE '' END || chr(10) AS markdown,
  CAST(doc_id % 3 + 1 AS INT) AS n_images, strlen(text) AS first_size FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"""


def _pixels(png: bytes) -> bytes:
    """Rows of a PNG file without their filter tags, which are all 0."""
    at, body, width, deep = 8, b"", 0, 0
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(png[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("bad checksum")
        if kind == b"IHDR":
            width, deep = int.from_bytes(data[:4], "big"), {0: 1, 2: 3}[data[9]]
        body += data if kind == b"IDAT" else b""
        at += 12 + size
    raw, step = zlib.decompress(body), width * deep + 1
    if any(raw[::step]):
        raise ValueError("unknown filter")
    return b"".join(raw[i + 1 : i + step] for i in range(0, len(raw), step))


def pdf_png_pixels(spark, sf):
    """The bytes of each text as a raster, written as PNG and read again."""

    def build(t: str) -> bytes:
        b = B.Builder()
        n = _raster(b, t.encode())
        b.page(b"q 1 0 0 1 50 700 cm /Im%d Do Q" % n, b"/XObject <</Im%d %d 0 R>>" % (n, n))
        return b.build()

    done = decode.convert_documents(as_pdf(_documents(spark, sf), "doc_id", "text", build), image_dir="figs").select("doc_id", F.get("images", F.lit(0))["bytes"].alias("png"))
    pixels = F.pandas_udf(lambda v: v.map(lambda x: None if x is None else _pixels(x)), "binary")
    return done.select("doc_id", F.hex(pixels("png")).alias("bytes"))


SQL_PIXELS = "SELECT doc_id, CASE WHEN text = '' THEN '202020' ELSE hex(encode(text)) || repeat('20', (3 - strlen(text) % 3) % 3) END AS bytes FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"


def _composite_pdf(t: str) -> bytes:
    """A font with two-byte codes whose meaning is in its character map alone."""
    b, lines = B.Builder(), _split(t)
    codes = {c: i for i, c in enumerate(sorted(set("".join(lines))), 1)}
    pairs = [b"<%04X> <%s>" % (n, c.encode("utf-16-be").hex().encode()) for c, n in codes.items()]
    maps = b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(p), b"\n".join(p)) for p in (pairs[i : i + 100] for i in range(0, len(pairs), 100)))
    cmap = b.stream(b"/CIDInit /ProcSet findresource begin\nbegincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n%s\nendcmap\nend" % maps, flate=True)
    font = b.add(b"<</Type /Font /Subtype /Type0 /BaseFont /Some /Encoding /Identity-H /ToUnicode %d 0 R>>" % cmap)
    digits = {ord(c): "%04x" % n for c, n in codes.items()}
    b.page(B.text_content(lines, show=lambda x: b"<%s> Tj" % x.translate(digits).encode()), b"/Font <</F1 %d 0 R>>" % font)
    return b.build()


def _differences_pdf(t: str) -> bytes:
    """Letters under the codes of others, 13 places on, which the font's differences put right."""
    b = B.Builder()
    turned = b" ".join(b"%d %s" % (first, b" ".join(b"/%c" % (first + (i + 13) % 26) for i in range(26))) for first in (65, 97))
    font = b.font(extra=b"/Encoding <</Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [%s]>>" % turned)
    b.page(B.text_content(_split(t), show=lambda x: B.literal(rot13(x, "rot13")) + b" Tj"), b"/Font <</F1 %d 0 R>>" % font)
    return b.build()


def _spaced_pdf(t: str) -> bytes:
    """Words without spaces between them, but numbers that move them apart."""
    b = B.Builder()
    font = b.font()
    b.page(B.text_content(_split(t), show=lambda x: b"[(%s)] TJ" % b") -250 (".join(filter(None, B.literal(x)[1:-1].split(b" ")))), b"/Font <</F1 %d 0 R>>" % font)
    return b.build()


def pdf_word_spacing(spark, sf):
    docs = _decorated(spark, sf).withColumn("text", F.regexp_replace("text", " +", " "))
    return decode.convert_documents(as_pdf(docs, "doc_id", "text", _spaced_pdf)).select("doc_id", "markdown")


SQL_SPACING = f"""WITH {SQL_DECORATED}, squeezed AS (SELECT doc_id, regexp_replace(text, ' +', ' ', 'g') AS text FROM decorated), {_sql_lines("squeezed")}, {_sql_pages()}
SELECT doc_id, {_QUOTES.format(_sql_title("coalesce(md, '')"))} AS markdown FROM decorated LEFT JOIN pages USING (doc_id)"""


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names, or for a local session without the setting a temporary one; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return place.toString()


#: Files in one folder: in larger ones each new name takes longer on some file systems.
FOLDER_FILES = 1000


def _placed(ending: str) -> Column:
    """A document's file, in a folder for a range of ids."""
    return F.concat(F.floor(F.col("doc_id") / FOLDER_FILES).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(ending))


def folder_roundtrip(spark, sf):
    """Files in a folder, some damaged, scanned and converted; the Markdown as files again. Damaged ones have none."""
    folder = shared_folder(spark, "folder-roundtrip")
    source = _documents(spark, sf).select("doc_id", F.struct("doc_id", "text").alias("v"))
    pdfs = as_pdf(source, "doc_id", "v", lambda v: B.text_pdf([_split(v["text"])]) if v["doc_id"] % 5 else b"no document")
    make_folder(f"{folder}/in")
    sinks.write_files(pdfs.select(_placed(".pdf").alias("name"), F.col("content").alias("data")), f"{folder}/in").count()
    done = decode.convert_documents(files.read_folder(spark, f"{folder}/in", recursive=True))
    sinks.write_markdown(done.withColumn("name", F.regexp_extract("path", r"([^/]*/[^/]*)\.pdf$", 1)), f"{folder}/out", "name").count()
    back = files.read_listed(files.list_folder(spark, f"{folder}/out", ".md", recursive=True))
    return back.select(F.regexp_extract("path", r"/(-?\d+)\.md$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("markdown"))


SQL_FOLDER = SQL_PDF.replace(SQL_DECORATED, "decorated AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL)")


def file_source(spark, sf):
    """The same through the data source, which tells the damaged ones."""
    folder = shared_folder(spark, "file-source")
    source = _documents(spark, sf).select("doc_id", F.struct("doc_id", "text").alias("v"))
    make_folder(folder)
    sinks.write_files(as_pdf(source, "doc_id", "v", _broken_pdf).select(_placed(".PDF").alias("name"), F.col("content").alias("data")), folder).count()
    files.register(spark)
    got = spark.read.format("pdf").option("recursiveFileLookup", "true").load(folder)
    return got.select(F.regexp_extract("path", r"/(-?[0-9]+)\.PDF$", 1).cast("long").alias("doc_id"), F.col("error.code").alias("code"), (F.col("markdown") == "\n").alias("blank"))


def bytes_source(spark, sf):
    """Byte strings converted in one call, in the order given."""
    rows = _table(spark, sf, "nation").where("n_nationkey IS NOT NULL").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    done = api.convert_many(spark, [B.text_pdf([[r.n_name]]) for r in rows])
    return spark.createDataFrame([(r.n_nationkey, d.markdown) for r, d in zip(rows, done)], "n_nationkey long, markdown string")


SQL_BYTES = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, '## ' || n_name || chr(10) AS markdown FROM nation WHERE n_nationkey IS NOT NULL"


def _table_pdf(ruled: bool):
    """Rows of (key, name), as text in two columns or between ruling lines."""

    def build(rows: list[dict]) -> bytes:
        b, y = B.Builder(), 700.0
        font = b.font()
        content = [b"BT /F1 10 Tf"]
        for r in rows:
            for x, t in ((50, str(r["k"])), (120, r["name"])):
                content.append(b"1 0 0 1 %d %g Tm %s Tj" % (x, y, B.literal(t)))
            y -= 20
        content.append(b"ET")
        if ruled:
            low = y + 14
            content += [b"45 %g m 245 %g l" % (low + 20 * i, low + 20 * i) for i in range(len(rows) + 1)]
            content += [b"%d %g m %d %g l" % (x, low, x, low + 20 * len(rows)) for x in (45, 115, 245)]
            content.append(b"S")
        b.page(b"\n".join(content), b"/Font <</F1 %d 0 R>>" % font)
        return b.build()

    return build


def _table_query(ruled: bool):
    def run(spark, sf):
        nations = _table(spark, sf, "nation").where("n_nationkey IS NOT NULL AND n_name IS NOT NULL")
        rows = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))).alias("rows"))
        return decode.convert_documents(as_pdf(rows, "n_regionkey", "rows", _table_pdf(ruled))).select("n_regionkey", "markdown")

    return run


SQL_TABLES = """WITH r AS (SELECT n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || trim(n_name) || ' |' || CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, n_name) = 1 THEN chr(10) || '| --- | --- |' ELSE '' END AS line FROM nation)
SELECT n_regionkey, string_agg(line, chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM r GROUP BY n_regionkey"""


def _styled_pdf(v: dict) -> bytes:
    b = B.Builder()
    bold, italic = v["size"] % 2 == 0, v["size"] % 3 == 0
    base = b"Times" + (b"-" if bold or italic else b"") + b"Bold" * bold + b"Italic" * italic
    plain, styled = b.font(), b.font(base)
    content = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (Parts.) Tj 1 0 0 1 50 650 Tm (It is) Tj /F2 12 Tf 1 0 0 1 250 650 Tm %s Tj /F1 12 Tf 1 0 0 1 450 650 Tm (here.) Tj ET"
    b.page(content % B.literal(v["name"]), b"/Font <</F1 %d 0 R /F2 %d 0 R>>" % (plain, styled))
    return b.build()


def pdf_emphasis(spark, sf):
    part = _table(spark, sf, "part").where("p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_size IS NOT NULL")
    files = as_pdf(part.select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("v")), "p_partkey", "v", _styled_pdf)
    return decode.convert_documents(files).select("p_partkey", "markdown")


SQL_PDF_EMPHASIS = """SELECT p_partkey, '# Parts.' || chr(10) || chr(10) || 'It is ' || w || p_name || w || ' here.' || chr(10) AS markdown
FROM (SELECT *, (CASE WHEN p_size % 2 = 0 THEN '**' ELSE '' END) || (CASE WHEN p_size % 3 = 0 THEN '*' ELSE '' END) AS w FROM part) WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_size IS NOT NULL"""


def _broken_pdf(v: dict) -> bytes:
    data = B.text_pdf([_split(v["text"])])
    old, new = [(b"", b""), (b"%PDF-", b"%pdf-"), (b"startxref", b"startxxxx"), (b"/Root 1 0 R", b"/Roof 1 0 R"), (b"/Length", b"/Langth")][v["doc_id"] % 5]
    return data.replace(old, new) if old else data


def pdf_errors(spark, sf):
    source = _documents(spark, sf).select("doc_id", F.struct("doc_id", "text").alias("v"))
    done = decode.convert_documents(as_pdf(source, "doc_id", "v", _broken_pdf))
    return done.select("doc_id", F.col("error.code").alias("code"), (F.col("markdown") == "\n").alias("blank"))


SQL_ERRORS = f"""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'NOT_PDF' WHEN 2 THEN 'XREF' WHEN 3 THEN 'OBJECT' END AS code,
  CASE doc_id % 5 WHEN 4 THEN true WHEN 0 THEN {_trim("text")} = '' END AS blank FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"""


def pdf_spans_formatted(spark, sf):
    """Decoded spans as a table, formatted again from it; documents without spans are empty ones."""
    docs = _decorated(spark, sf)
    files = as_pdf(docs, "doc_id", "text", lambda t: B.text_pdf([_split(t)], packed=True))
    spans = decode.spans(decode.decode_documents(files))
    pages = layout.format_spans(spans)
    done = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "markdown"))).alias("p"))
    done = docs.select("doc_id").join(done, "doc_id", "left")
    return text.finish(done, F.coalesce(F.col("p.markdown"), F.array().cast("array<string>"))).select("doc_id", "markdown")

_LINE = {
    "heading_shapes": _line_query(lambda c: {"shaped": L.heading_shaped(c), "words": L.word_count(c).cast("long")}, None, ", shaped, words", ""),
    "all_caps_headings": _line_query(lambda c: {}, L.all_caps, "", " WHERE all_caps"),
    "numbered_headings": _line_query(lambda c: {"bare": L.strip_number(c)}, L.numbered, ", bare", " WHERE numbered"),
    "short_titles": _line_query(lambda c: {}, L.short_title, "", " WHERE short_title"),
    "heading_levels": _line_query(lambda c: {"level": L.heading_level(c), "section": L.named_section(c)}, None, ", CAST(level AS INT) AS level, section", ""),
    "list_items": _line_query(lambda c: {"item": L.list_item(c)}, L.is_list_item, ", item", " WHERE item IS NOT NULL"),
}

_ALL: dict[str, tuple[Callable, str]] = {
    "text_to_markdown": (text_to_markdown, SQL_TEXT_TO_MARKDOWN),
    **_LINE,
    "dehyphenate_paragraphs": (dehyphenate_paragraphs, SQL_DEHYPHENATE),
    "title_and_end": (title_and_end, SQL_TITLE),
    "page_join": _page_join(False),
    "page_breaks": _page_join(True),
    "running_margins": (running_margins, f"WITH {SQL_CONV} SELECT doc_id, text FROM margins"),
    "strip_running_margins": (strip_running_margins, f"WITH {SQL_CONV} SELECT doc_id, page_idx, n - 1 AS seq, line AS text FROM cs WHERE NOT EXISTS (SELECT 1 FROM margins m WHERE m.doc_id = cs.doc_id AND m.text = cs.line)"),
    "font_style_sniff": (font_style_sniff, SQL_STYLE),
    "emphasis_spans": (emphasis_spans, SQL_EMPHASIS),
    "weighted_median_size": (weighted_median_size, SQL_MEDIAN),
    "x_histogram": (x_histogram, SQL_HISTOGRAM),
    "column_gaps": (column_gaps, SQL_GAPS),
    "line_islands": (line_islands, SQL_ISLANDS),
    "visual_lines": (visual_lines, SQL_VISUAL),
    "cluster_edges": (cluster_edges, SQL_CLUSTER),
    "span_to_cell": (span_to_cell, SQL_CELLS),
    "gfm_tables": (gfm_tables, SQL_GFM),
    "image_numbering": (image_numbering, SQL_NUMBERING),
    "image_links": (image_links, SQL_LINKS),
    "role_first_wins": (role_first_wins, SQL_FIRST),
    "xref_newest_wins": (xref_newest_wins, SQL_NEWEST),
    "cmap_ranges": (cmap_ranges, SQL_CMAP),
    "cmyk_to_rgb": (cmyk_to_rgb, SQL_CMYK),
    "flate_roundtrip": (flate_roundtrip, SQL_SAME),
    "ascii85_roundtrip": (ascii85_roundtrip, SQL_SAME),
    "asciihex_roundtrip": (asciihex_roundtrip, SQL_SAME),
    "predictor_roundtrip": (predictor_roundtrip, SQL_PADDED),
    "pdf_roundtrip_text": (_pdf_query(lambda t: B.text_pdf([_split(t)])), SQL_PDF),
    "pdf_composite_fonts": (_pdf_query(_composite_pdf), SQL_TEXT_TO_MARKDOWN),
    "pdf_encoding_differences": (_pdf_query(_differences_pdf), SQL_PDF),
    "pdf_word_spacing": (pdf_word_spacing, SQL_SPACING),
    "pdf_png_pixels": (pdf_png_pixels, SQL_PIXELS),
    "flate_stored_roundtrip": (flate_stored_roundtrip, SQL_SAME),
    "folder_roundtrip": (folder_roundtrip, SQL_FOLDER),
    "file_source": (file_source, SQL_ERRORS),
    "bytes_source": (bytes_source, SQL_BYTES),
    "pdf_objstm_roundtrip": (_pdf_query(lambda t: B.text_pdf([_split(t)], packed=True)), SQL_PDF),
    "pdf_forms_roundtrip": (_pdf_query(_form_pdf), SQL_PDF),
    "pdf_spans_formatted": (pdf_spans_formatted, SQL_PDF),
    "pdf_multipage_roundtrip": (pdf_multipage_roundtrip, SQL_MULTIPAGE),
    "pdf_tagged_headings": (pdf_tagged_headings, SQL_TAGGED),
    "pdf_images": (pdf_images, SQL_IMAGES),
    "pdf_borderless_tables": (_table_query(False), SQL_TABLES),
    "pdf_ruled_tables": (_table_query(True), SQL_TABLES),
    "pdf_emphasis": (pdf_emphasis, SQL_PDF_EMPHASIS),
    "pdf_errors": (pdf_errors, SQL_ERRORS),
    "token_quality": (token_quality_by_role, SQL_QUALITY),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}

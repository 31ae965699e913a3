"""Named queries over the test tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

import re
import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from vellumspark.operators import checksums, glyphs, masks
from vellumspark.operators import relational as R
from vellumspark.operators.checksums import POLYNOMIAL
from vellumspark.operators.partition import CHUNK_CODES
from vellumspark.operators.shape import tree_issues
from vellumspark.sources import package_files
from vellumspark.sources.shared import scope, shared_dir, spread, written

from . import digests, flow, packages
from .compile import Corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, css: list[str] | None = None, keep: bool = True) -> Corpus:
    p = table(spark, sf_dir, "pages")
    return Corpus(p.select(F.col("page_id").alias("doc_id"), F.lit("html").alias("kind"), F.col("html").alias("source")), css, keep=keep)


def prose(spark: SparkSession, sf_dir: str) -> Corpus:
    """For queries of one view, which parse in the pass that answers them."""
    d = table(spark, sf_dir, "documents")
    return Corpus(d.select("doc_id", F.lit("markdown").alias("kind"), F.col("text").alias("source")), keep=False)


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


SEGMENTS = r"""
body as (select page_id, regexp_replace(regexp_replace(html, '^.*?<body>', '', 's'), '<!--.*?-->', '', 'gs') as b from pages),
parts as (select page_id, unnest(string_split(regexp_replace(regexp_replace(b, '<(/?)(p|li|h1|div|article|nav|ul|footer|br)( [^>]*)?>', chr(1), 'g'), '</?[a-z][^>]*>', '', 'g'), chr(1))) as t,
          generate_subscripts(string_split(regexp_replace(regexp_replace(b, '<(/?)(p|li|h1|div|article|nav|ul|footer|br)( [^>]*)?>', chr(1), 'g'), '</?[a-z][^>]*>', '', 'g'), chr(1)), 1) as k from body),
texts as (select page_id, k, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) as t from parts)
"""
#: The texts of a page in order, numbered over the page (i) and after its list (r), whether a break follows (br), the items of
#: the list (li), the number of texts (m), of contents (ci), and the id of the chunk that a text after the list is in.
PLACED = SEGMENTS.replace("body as (select page_id, regexp_replace(", "body as (select page_id, replace(regexp_replace(").replace("'gs') as b", "'gs'), '<br>', chr(2) || '<br>') as b") + r""",
l as (select page_id, ((length(html) - length(replace(html, '<li>', ''))) // 4)::int as li from pages),
q as (select page_id, k, trim(replace(t, chr(2), '')) as t, (contains(t, chr(2)))::int as br from texts),
t as (select *, (row_number() over (partition by page_id order by k))::int as i from q where t <> ''),
u as (select t.page_id, t.t, t.i, t.br, l.li, t.i - l.li as r, (count(*) over (partition by t.page_id))::int as m, min(t.i) over (partition by t.page_id, t.t) as f,
      coalesce(sum(t.br) over (partition by t.page_id order by t.i rows between unbounded preceding and 1 preceding), 0)::int as breaks from t join l on t.page_id = l.page_id),
n as (select *, (dense_rank() over (partition by page_id order by f))::int as ci, 2 + 3 * li + 2 * (r - 1) + 1 + breaks as id from u)
"""
TITLE = r"""trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'))"""
FOLDED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    "with " + SEGMENTS + r""", counts as (select page_id, length(html) - length(replace(html, '<li>', '')) as li, length(html) - length(replace(html, '<br>', '')) as br, length(html) - length(replace(html, '<p>', '')) as p from pages),
    runs as (select page_id, count(*) as n from texts where t <> '' group by page_id),
    k as (select page_id, unnest(['document', 'heading1', 'list', 'list_item', 'br', 'paragraph', 'run']) as kind, unnest([1, 1, 1, li // 4, br // 4, li // 4 + p // 3 + 2, runs.n]) as n from counts join runs using (page_id))
    select page_id, kind, n::bigint as n from k where n > 0"""
)
def chunk_kind_counts(spark, sf_dir):
    """AG4: chunks by kind of each page."""
    return pages(spark, sf_dir, keep=False).parsed.select(F.col("doc_id").alias("page_id"), F.explode("chunks").alias("c")).groupBy("page_id", F.col("c.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(f"select page_id, {TITLE} as title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, len(regexp_extract_all(html, '<style>(.*?)</style>', 1))::int as n_sheets from pages")
def doc_meta(spark, sf_dir):
    """PAR4: title, language and number of style sheets."""
    return pages(spark, sf_dir, keep=False).meta.select(F.col("doc_id").alias("page_id"), "title", "lang", F.size("stylesheets").alias("n_sheets"))


@query("select page_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1)) as css from pages")
def stylesheets(spark, sf_dir):
    """PAR4: the texts of a page's style elements."""
    return pages(spark, sf_dir, keep=False).meta.select(F.col("doc_id").alias("page_id"), F.explode("stylesheets").alias("css"))


@query("select page_id, sha256(html) as source_digest from pages")
def source_digest(spark, sf_dir):
    """AG15."""
    return table(spark, sf_dir, "pages").select("page_id", sha(F.col("html")).alias("source_digest"))


@query(r"""select page_id, u as href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as u from pages) group by page_id, u""")
def link_targets(spark, sf_dir):
    """AG5: targets of links, by the runs that carry them."""
    x = pages(spark, sf_dir, keep=False).extras.where("kind = 'link_target'")
    return x.groupBy(F.col("doc_id").alias("page_id"), F.col("text").alias("href")).agg(F.count("*").alias("n"))


@query("with " + SEGMENTS + "select page_id, t as text, (row_number() over (partition by page_id order by min(k)) - 1)::int as payload_id from texts where t <> '' group by page_id, t")
def text_dedupe(spark, sf_dir):
    """AG3: a page's texts once each, numbered by first use."""
    return pages(spark, sf_dir, keep=False).content.where("kind = 'text_utf8'").select(F.col("doc_id").alias("page_id"), "text", "payload_id")


@query("with " + SEGMENTS + "select page_id, sum(strlen(t))::bigint as bytes, count(*) as payloads from (select distinct page_id, t from texts where t <> '') group by page_id")
def text_bytes(spark, sf_dir):
    """AG7: bytes of a page's texts."""
    c = pages(spark, sf_dir, keep=False).content.where("kind = 'text_utf8'")
    return c.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("payloads"))


@query("with " + SEGMENTS + "select page_id, unicode(c)::bigint as cp from (select distinct page_id, unnest(string_split(t, '')) as c from texts where t <> '' union select page_id, '•' from pages)")
def codepoints(spark, sf_dir):
    """AG1, ST2: codepoints of a page's texts and list markers, over all faces."""
    return pages(spark, sf_dir).codepoints.select(F.col("doc_id").alias("page_id"), F.col("cp").cast("long").alias("cp")).distinct()


@query(f"select doc_id, {FOLDED} as text from documents")
def md_text(spark, sf_dir):
    """PAR10, FS3: the text of a Markdown document."""
    return prose(spark, sf_dir).plain_text.select("doc_id", "text")


@query(f"select doc_id, strlen({FOLDED})::bigint as bytes, length({FOLDED})::bigint as chars from documents")
def md_text_bytes(spark, sf_dir):
    """AG7, AG12."""
    t = prose(spark, sf_dir).plain_text
    return t.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"))


@query(f"select doc_id, substr(sha256({FOLDED}), 1, 32) as content_id from documents")
def content_id(spark, sf_dir):
    """AG14's digest, over a document's text."""
    return prose(spark, sf_dir).plain_text.select("doc_id", F.substring(sha(F.col("text")), 1, 32).alias("content_id"))


@query(f"select doc_id, nfc_normalize({FOLDED}) as text, length(nfc_normalize({FOLDED}))::bigint as chars from documents")
def nfc_text(spark, sf_dir):
    """FS1, FS2: white space and Unicode form in expressions alone."""
    from vellumspark.functions.text import collapse_column, nfc_column

    d = table(spark, sf_dir, "documents").select("doc_id", nfc_column(F.trim(collapse_column(F.col("text")))).alias("text"))
    return d.select("doc_id", "text", F.char_length("text").cast("long").alias("chars"))


@query("select page_id, 'ul' as parent, k::int as pos, u as href from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as u, unnest(range(0, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))) as k from pages)")
def tree_links(spark, sf_dir):
    """WN1, JN8: links of the semantic tree with their place in the list: a self-join of nodes on parents."""
    n = pages(spark, sf_dir).nodes
    links = n.where("kind = 'link'").select("doc_id", F.col("parent_id").alias("item"), "href")
    items = n.where("kind = 'list_item'").select("doc_id", F.col("node_id").alias("item"), F.col("parent_id").alias("list"), F.element_at("path", -1).alias("pos"))
    lists = n.where("kind = 'unordered_list'").select("doc_id", F.col("node_id").alias("list"), F.col("tag").alias("parent"))
    return links.join(items, ["doc_id", "item"]).join(lists, ["doc_id", "list"]).select(F.col("doc_id").alias("page_id"), "parent", "pos", "href")


@query(
    r"""with s as (select page_id from pages) select page_id, 'h1' as tag, 32.0::double as font_size_px, 700 as font_weight, 21.44::double as margin_top from s
    union all select page_id, 'ul', 16.0, 400, 0.0 from s"""
)
def resolved_styles(spark, sf_dir):
    """TR6: sizes, weights and margins that headings and lists come to."""
    c = pages(spark, sf_dir)
    asked = c.requests.where("tag in ('h1', 'ul')").select("doc_id", "request", "tag")
    s = c.computed.select("doc_id", "request", "font_size_px", "font_weight", "margin_top")
    return asked.join(s, ["doc_id", "request"]).select(F.col("doc_id").alias("page_id"), "tag", F.col("font_size_px").cast("double").alias("font_size_px"), "font_weight", F.round(F.col("margin_top").cast("double"), 4).alias("margin_top"))


@query(r"""select page_id, unnest(['h1', 'li', 'ul']) as tag, unnest([1, length(html) - length(replace(html, '<li>', '')), 4])::bigint // unnest([1, 4, 4]) as n from pages""")
def selector_matches(spark, sf_dir):
    """JN1: requests that rules for h1, li and ul fit."""
    c = pages(spark, sf_dir)
    m = c.matches.select("doc_id", "request").distinct().join(c.requests.select("doc_id", "request", "tag"), ["doc_id", "request"]).where("tag in ('h1', 'li', 'ul')")
    return m.groupBy(F.col("doc_id").alias("page_id"), "tag").agg(F.count("*").alias("n"))


# The relational operators by themselves, on the tables that have the shape they ask for.


@query(
    """select l_orderkey, l_linenumber, coalesce(lag(l_linenumber) over w, 0)::int as prev_id, coalesce(lead(l_linenumber) over w, 0)::int as next_id,
    min(l_linenumber) over (partition by l_orderkey) as first_id, max(l_linenumber) over (partition by l_orderkey) as last_id from lineitem window w as (partition by l_orderkey order by l_linenumber)"""
)
def sibling_links(spark, sf_dir):
    """WN2, WN3."""
    return R.sibling_links(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("select user_id, event_type, (row_number() over (partition by user_id order by min(event_id)) - 1)::int as type_id from events group by user_id, event_type")
def first_seen_ids(spark, sf_dir):
    """WN9, AG2: distinct values numbered by first occurrence."""
    return R.first_seen(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], "event_id", "type_id").select("user_id", "event_type", "type_id")


@query("""select l_orderkey, l_linenumber, case when l_quantity > 10 then 3 + count(*) filter (l_quantity > 10) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) - 1 end as value from lineitem""")
def list_numbering(spark, sf_dir):
    """WN5: items numbered from a start; what is no item doesn't count."""
    d = table(spark, sf_dir, "lineitem")
    return R.numbered(d, ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 10, F.lit(3)).select("l_orderkey", "l_linenumber", "value")


@query("select event_id, (sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding))::bigint as segment from events")
def segments(spark, sf_dir):
    """WN11, WN12: runs between breaks."""
    return R.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id", "segment")


@query(
    """select c_custkey, s_acctbal from (select c_custkey, s_acctbal, row_number() over (partition by c_custkey order by abs(s_acctbal - c_acctbal), s_acctbal desc) as n
    from customer join supplier on c_nationkey = s_nationkey) where n = 1"""
)
def nearest_match(spark, sf_dir):
    """JN3: the nearest value under an equal key; the larger of two as near."""
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    return R.nearest(table(spark, sf_dir, "customer"), have, ["c_nationkey"], "c_acctbal", "s_acctbal").select("c_custkey", "s_acctbal")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def dangling_refs(spark, sf_dir):
    """JN5, JN6, JN7: references without a target."""
    part = table(spark, sf_dir, "part").where("p_size > 10")
    return R.dangling(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), part, "p_partkey").select("l_orderkey", "l_linenumber")


@query(ORACLES["dangling_refs"])
def dangling_refs_all(spark, sf_dir):
    """The same: the name that the query over all rows had while dangling_refs looked at some."""
    return dangling_refs(spark, sf_dir)


@query("select user_id, event_type, count(*) as n from events group by user_id, event_type having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """ST4."""
    return R.duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events) where n <= 8")
def first_issues(spark, sf_dir):
    """LM1: the first eight rows of each group."""
    return R.top(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 8).select("user_id", "event_id")


@query("select p_partkey, case when s <= 64 then 64 when s <= 128 then 128 when s <= 256 then 256 when s <= 512 then 512 when s <= 1024 then 1024 else 2048 end as side from (select p_partkey, floor(greatest(64, ceil(sqrt(p_size * p_size * 1600 / 0.75)))) as s from part)")
def page_size(spark, sf_dir):
    """TR9."""
    return table(spark, sf_dir, "part").select("p_partkey", R.page_size(F.col("p_size") * F.col("p_size")).alias("side"))


@query("select l_returnflag, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 9) as rmse, round(max(abs(l_discount - l_tax)), 9) as worst from lineitem group by l_returnflag")
def coverage_error(spark, sf_dir):
    """AG20."""
    e = R.coverage_error(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount"), F.col("l_tax"))
    return e.select("l_returnflag", F.round("rmse", 9).alias("rmse"), F.round("worst", 9).alias("worst"))


@query("select l_orderkey, last(l_shipdate order by (l_returnflag, l_linenumber, l_shipdate)) as shipdate from lineitem group by l_orderkey")
def last_wins(spark, sf_dir):
    """WN7: the value of the row that comes last in an order."""
    d = table(spark, sf_dir, "lineitem").withColumn("shipdate", F.col("l_shipdate"))
    return R.last_wins(d, ["l_orderkey"], ["shipdate"], ["l_returnflag", "l_linenumber", "l_shipdate"])


@query("select distinct c.c_custkey, o.o_orderpriority from customer c join orders o on c.c_custkey = o.o_custkey where (c.c_mktsegment, o.o_orderpriority) not in (select ('BUILDING', '1-URGENT') union all select ('MACHINERY', '5-LOW'))")
def shape_violations(spark, sf_dir):
    """FIL5, FIL6: pairs outside a list of allowed ones (here: outside those listed)."""
    allowed = spark.createDataFrame([("BUILDING", "1-URGENT"), ("MACHINERY", "5-LOW")], "c_mktsegment string, o_orderpriority string")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(F.broadcast(allowed), ["c_mktsegment", "o_orderpriority"], "left_anti").select("c_custkey", "o_orderpriority").distinct()


# The compiled tables themselves. All pages of the test tables have one shape: a list of links, a notice, a heading, paragraphs and a footer.


@query(
    f"with {PLACED}, g as (select page_id, max(li) as li, max(m) as m, sum(br) as br, max(ci) as contents from n group by page_id) "
    + f"""select pages.page_id as doc_id, {TITLE} as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, null::varchar as error, (2 + 3 * li + 2 * (m - li) + br)::int as chunk_count,
    8::bigint as style_count, contents::bigint as content_count, 2::bigint as atlas_count, 0::bigint as image_count from pages join g on pages.page_id = g.page_id"""
)
def corpus_report(spark, sf_dir):
    """AG10: counts of each compiled page."""
    return pages(spark, sf_dir).report


#: The chunk table.
CHUNKS = PLACED + r""", c as (
    select page_id, 1 as chunk_id, 'document' as kind, 16 as flags, 0 as style_id, 0 as parent_id, 0 as content_index, 0 as depth, null as text from l
    union all select page_id, 2, 'list', 16, 1, 1, 0, 1, null from l where li > 0
    union all select page_id, 3 * i, 'list_item', 0, 2, 2, 0, 2, null from n where r <= 0
    union all select page_id, 3 * i + 1, 'paragraph', 0, 2, 3 * i, 0, 3, null from n where r <= 0
    union all select page_id, 3 * i + 2, 'run', 0, 3, 3 * i + 1, ci, 4, t from n where r <= 0
    union all select page_id, id, case when r = 2 then 'heading1' else 'paragraph' end, 0, case when r = 1 then 0 when r = 2 then 4 when i = m then 7 else 5 end, 1, 0, 1, null from n where r > 0
    union all select page_id, id + 1, 'run', 0, case when r = 1 then 0 when r = 2 then 4 when i = m then 7 else 6 end, id, ci, 2, t from n where r > 0
    union all select page_id, id + 2, 'br', 0, 0, id, 0, 2, null from n where br > 0)
"""


@query(
    f"with {CHUNKS}"
    + r""",
    ends as (select page_id, parent_id as chunk_id, min(chunk_id) as a, max(chunk_id) as z from c group by page_id, parent_id)
    select c.page_id as doc_id, c.chunk_id::int as chunk_id, kind, flags::int as flags, style_id::int as style_id, parent_id::int as parent_id,
    coalesce(lag(c.chunk_id) over w, 0)::int as prev_id, coalesce(lead(c.chunk_id) over w, 0)::int as next_id, coalesce(a, 0)::int as first_child_id, coalesce(z, 0)::int as last_child_id,
    content_index::int as content_index, (c.chunk_id - 1)::int as ordinal, depth::int as depth, text
    from c left join ends on c.page_id = ends.page_id and c.chunk_id = ends.chunk_id window w as (partition by c.page_id, parent_id order by c.chunk_id)"""
)
def compiled_chunks(spark, sf_dir):
    """TR7, WN1-4, AG2, AG3: the chunk table."""
    return pages(spark, sf_dir).chunks


#: What the style sheets of the test pages come to.
STYLE_ROWS = """(1, 9, 'margin_bottom', 16.0), (1, 12, 'list_style', 1.0), (2, 9, 'margin_bottom', 4.0), (2, 12, 'list_style', 1.0), (3, 9, 'margin_bottom', 4.0), (3, 12, 'list_style', 1.0),
    (3, 14, 'underline', 1.0), (4, 1, 'font_id', 1.0), (4, 2, 'font_size_px', 32.0), (4, 4, 'font_weight', 700.0), (4, 8, 'margin_top', 21.44::float::double), (4, 9, 'margin_bottom', 21.44::float::double),
    (5, 9, 'margin_bottom', 16.0), (6, 1, 'font_id', 1.0), (6, 4, 'font_weight', 700.0), (6, 9, 'margin_bottom', 16.0), (7, 1, 'font_id', 1.0), (7, 4, 'font_weight', 700.0)"""


@query(f"select page_id as doc_id, s::int as style_id, tag::int as tag, name, value::double as value from pages, (values {STYLE_ROWS}) as v(s, tag, name, value)")
def page_styles(spark, sf_dir):
    """AG2, TR8, FIL8, SO7: the properties of a page's styles that differ from the default, numbered by first use."""
    return pages(spark, sf_dir).style_properties


@query()
def compiled_styles(spark, sf_dir):
    """AG2, FIL8: styles as properties, with a user sheet whose rules name wrappers, which aren't nodes of the tree, and a class."""
    return pages(spark, sf_dir, ["article p b { color: #369; } .ad { font-size: 80% } nav li a { text-decoration: none; letter-spacing: 0.1em }"]).style_properties


RUN_SHEET = "strong { color: #f00 } p strong { color: #369; } .ad { font-size: 80% } ul li a { text-decoration: none; letter-spacing: 0.1em } .ad a, table p { color: #0f0 }"


@query(
    f"with {PLACED} select page_id as doc_id, i::int as place, case when r = 1 then 12.8::float::double when r = 2 then 32.0 else 16.0 end as font_size_px, "
    "case when r < 3 then 255 when i < m then 862362111 else 4278190335 end::bigint as color, false as underline, case when r <= 0 then 1.6::float::double else 0.0 end as letter_spacing from n"
)
def cascaded_runs(spark, sf_dir):
    """JN1, JN2, WN7, WN8, TR6: what each run comes to under rules with a class and with descendants: the notice, the list's links, the article's bold text."""
    c = pages(spark, sf_dir, [RUN_SHEET])
    runs = c.parsed.select("doc_id", F.inline("chunks")).where("kind = 'run'").select("doc_id", "request", "chunk_id")
    s = c.computed.select("doc_id", "request", *[F.col(x).cast("double").alias(x) for x in ("font_size_px", "letter_spacing")], "color", "underline")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_id"))
    return runs.join(s, ["doc_id", "request"]).select("doc_id", place.alias("place"), "font_size_px", "color", "underline", "letter_spacing")


@query(
    f"with {PLACED}, c as (select page_id, case when r <= 1 then 400 else 700 end as weight, unicode(unnest(string_split(t, '')))::int as cp from n union select page_id, 400, 8226 from l where li > 0) "
    "select page_id as doc_id, 'Noto Sans' as family, weight::int as weight, false as italic, count(*) as n, sha256(string_agg(cp::varchar, ',' order by cp)) as digest from c group by page_id, weight"
)
def face_codepoints(spark, sf_dir):
    """AG1, AG11, SO5: how many codepoints each face of a page must hold."""
    c = pages(spark, sf_dir)
    return c.codepoints.groupBy("doc_id", "family", "weight", "italic").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_set("cp")), ","), 256).alias("digest"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as packages, unpacked again: decoded rows of what was encoded, deflated and sealed."""
    source = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))
    return written(packages.unpack(packages.pack(pages(spark, sf_dir), source)), "unpacked")


@query(
    f"with {PLACED}, g as (select page_id, max(li) as li, max(m) as m, sum(br) as br, max(ci) as contents from n group by page_id), b as (select page_id, sum(strlen(t)) as bytes from (select distinct page_id, t from n) group by page_id), "
    + r"""links as (select page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as links from pages),
    k as (select g.page_id, unnest(['chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'extras', 'styles', 'content', 'content', 'content', 'images', 'images', 'seal']) as topic,
          unnest(['document', 'heading1', 'list', 'list_item', 'br', 'paragraph', 'run', 'link_target', 'properties', 'texts', 'text bytes', 'image references', 'images', 'pixels', 'sections covered']) as name,
          unnest([1, 1, 1, li, br, m - 1, m, links, 18, contents, bytes, 0, 0, 0, 5])::bigint as n from g join b using (page_id) join links using (page_id))
    select page_id as doc_id, topic, name, n from k where n > 0 or topic in ('content', 'images')"""
)
def package_report(spark, sf_dir):
    """SNK1, SNK3, AG4-AG9, CD1-CD9: what the packages of all pages hold, but for the sizes of their compressed sections."""
    return packages.inspect(None, packed(spark, sf_dir)).where("topic not like 'section %'")


@query(
    """select page_id as doc_id, v.section, v.message from pages, (values ('GLYF', 'document contains text but no glyph atlas'), ('STYL', 'style 4 references font_id 1 but there are 0 atlases'),
    ('STYL', 'style 6 references font_id 1 but there are 0 atlases'), ('STYL', 'style 7 references font_id 1 but there are 0 atlases')) as v(section, message)"""
)
def package_issues(spark, sf_dir):
    """V1-V17, JN5-JN10, WN2-WN3: all checks over the packages of all pages, which lack their atlases and are otherwise sound."""
    return packages.validate(None, packed(spark, sf_dir))


def package_folder(spark: SparkSession, sf_dir: str) -> str:
    """The pages as package files, in a new folder of the shared one."""
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))
    made = packages.pack(pages(spark, sf_dir), source)
    package_files.write(made.select(F.col("doc_id").cast("string").alias("name"), "bytes"), folder)
    return folder


@query(ORACLES["chunk_kind_counts"])
def package_chunk_kinds(spark, sf_dir):
    """SRC5, SNK1, SNK2, CD11: chunks by kind of package files, which executors wrote; their CHNK sections alone are read back."""
    p = package_files.read(spark, package_folder(spark, sf_dir), ["chunks"]).where("error is null")
    c = p.select(F.col("name").cast("long").alias("page_id"), F.explode("chunks").alias("c"))
    return c.groupBy("page_id", F.col("c.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""with {PLACED}, g as (select page_id, max(li) as li, max(m) as m, sum(br) as br, max(ci) as contents from n group by page_id),
    b as (select page_id, sum(strlen(t)) as bytes from (select distinct page_id, t from n) group by page_id),
    x as (select page_id, html, {TITLE} as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as links,
          coalesce(list_sum(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda u: strlen(u))), 0) as link_bytes from pages),
    s as (select page_id, unnest(['INFO', 'CHNK', 'STYL', 'CONT', 'GLYF', 'SEAL']) as name, unnest([
          strlen(format('{{{{"atlas_count":0,"chunk_count":{{}},"content_count":{{}},"document_id":"","format_version":1,"generator":"vellumspark","generator_version":"1","image_count":0,"lang":"{{}}","source_digest":"","style_count":8,"title":"{{}}"}}}}',
                        2 + 3 * li + 2 * (m - li) + br, contents, lang, replace(replace(title, '\\', '\\\\'), '"', '\\"'))) + 32 + 64,
          4 + 44 * (2 + 3 * li + 2 * (m - li) + br) + 4 + 10 * links + link_bytes, 4 + 8 * 8 + {sum(2 + n for n in (4, 1, 4, 1, 4, 1, 1, 4, 4, 2, 4, 4, 4, 4, 2, 4, 4, 2))}, 4 + 12 * contents + bytes, 4, 4 + 36 * 5 + 32])::bigint as decoded_len
          from g join b using (page_id) join x using (page_id)) select page_id, name, decoded_len, name in ('INFO', 'CHNK', 'STYL', 'CONT') as compressed from s"""
)
def package_sections(spark, sf_dir):
    """SNK3, CD1, CD2: what the directories of the package files say of their sections; no section is read."""
    p = package_files.read(spark, package_folder(spark, sf_dir), ["sections"])
    return p.select(F.col("name").cast("long").alias("page_id"), F.inline("sections")).select("page_id", "name", "decoded_len", "compressed")


def edited(column: str, at: Column, **fields: Column) -> Column:
    """An array of structs with some fields of the elements at which a condition on them holds replaced."""

    def edit(x: Column) -> Column:
        new = x
        for k, v in fields.items():
            new = new.withField(k, v(x) if callable(v) else v)
        return F.when(at(x), new).otherwise(x)

    return F.transform(column, edit)


def breaks(info_type: DataType) -> dict[str, dict[str, Column]]:
    """What each way to break a decoded package, a sound one, puts into its columns."""
    n, zero = F.size("chunks").cast("long"), F.lit(0).cast("long")
    long = lambda v: F.lit(v).cast("long")
    last, up = (lambda c: c["chunk_id"] == n), (lambda c: c["chunk_id"] == n - 1)
    chunk = lambda which, **f: {"chunks": edited("chunks", which, **f)}
    info = lambda **f: {"info": _with(F.col("info"), f)}
    first = lambda p: p["payload_id"] == 0
    return {
        "no info": {"info": F.lit(None).cast(info_type)},
        "chunk count": info(chunk_count=n + 1),
        "style count": info(style_count=long(3)),
        "content count": info(content_count=zero),
        "atlas count": info(atlas_count=long(9)),
        "image count": info(image_count=long(1)),
        "no chunks": {"chunks": F.slice("chunks", 1, 0)},
        "ordinal": chunk(last, ordinal=n + 4),
        "style": chunk(last, style_id=long(99)),
        "content": chunk(last, content_index=long(9999)),
        "image without content": chunk(last, kind=F.lit("image"), content_index=zero),
        "image of a text": chunk(last, kind=F.lit("image")),
        "two roots": chunk(last, parent_id=zero),
        "root kind": chunk(lambda c: c["chunk_id"] == 1, kind=F.lit("table_cell")),
        "depth": chunk(last, depth=long(7)),
        "parent": chunk(last, parent_id=n + 7),
        "shape": chunk(last, kind=F.lit("table")),
        "own next": chunk(last, next_id=n),
        "prev": chunk(last, prev_id=long(1)),
        "child": chunk(up, first_child_id=n + 9),
        "last child": chunk(up, last_child_id=long(1)),
        "wrong chain": chunk(last, next_id=long(2)),
        "font": info(atlas_count=long(1)) | {"atlases": F.slice("atlases", 1, 1)},
        "no atlas": info(atlas_count=zero) | {"atlases": F.slice("atlases", 1, 0)},
        "image length": {"content": edited("content", first, kind=F.lit("image_ref"), image=F.lit(None).cast("long"), bytes=long(3))},
        "image": {"content": edited("content", first, kind=F.lit("image_ref"), image=long(5), bytes=long(4))},
        "link": {"extras": edited("extras", lambda x: F.lit(True), data=lambda x: F.substring(x["data"], F.lit(1), F.octet_length(x["data"]) - 1))},
    }


def broken(rows: DataFrame, ways: dict[str, dict[str, Column]], first: int) -> DataFrame:
    """A row of rows(doc_id, ...) for each way, with what the way puts into its columns. doc_id is the row's times 100 and the way's number, from first on."""
    cases: dict[str, Column] = {}
    for k, put in enumerate(ways.values()):
        for c, value in put.items():
            at = F.col("way") == k
            cases[c] = cases[c].when(at, value) if c in cases else F.when(at, value)
    cols = [cases[c].otherwise(F.col(c)).alias(c) if c in cases else F.col(c) for c in rows.columns if c != "doc_id"]
    each = rows.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(len(ways) - 1))))
    # a generator's row is made once, where a projection would be made again at each place that names its columns
    return each.select(F.inline(F.array(F.struct((F.col("doc_id") * 100 + first + F.col("way")).alias("doc_id"), *cols))))


def _with(x: Column, fields: dict[str, Column]) -> Column:
    for k, v in fields.items():
        x = x.withField(k, v)
    return x


@query(
    f"""with {CHUNKS}, g as (select page_id, max(li) as li, max(m) as m, sum(br) as br, max(ci) as contents from n group by page_id),
    s as (select page_id as id, 2 + 3 * li + 2 * (m - li) + br as n, contents as k from g),
    """
    + r"""i as (
    select id, 'no info' as way, 'INFO' as section, 'required INFO section missing or undecodable' as message from s
    union all select id, unnest(['chunk count', 'style count', 'content count', 'atlas count', 'image count', 'no chunks', 'no chunks']), unnest(['INFO', 'INFO', 'INFO', 'INFO', 'INFO', 'INFO', 'CHNK']),
        unnest([format('chunk_count declares {} but the section contains {}', n + 1, n), 'style_count declares 3 but the section contains 8', format('content_count declares 0 but the section contains {}', k),
        'atlas_count declares 9 but the section contains 2', 'image_count declares 1 but the section contains 0', format('chunk_count declares {} but the section contains 0', n), 'no chunks']) from s
    union all select id, unnest(['ordinal', 'style', 'content', 'image without content', 'image without content', 'image of a text', 'image of a text']), 'CHNK',
        unnest([format('chunk {} has ordinal {}', n, n + 4), format('chunk {} references style 99', n), format('chunk {} references content 9999', n), format('image chunk {} has no content', n),
        format('chunk {}: image in paragraph', n), format('image chunk {} shows a text', n), format('chunk {}: image in paragraph', n)]) from s
    union all select id, 'two roots', 'CHNK', unnest(['2 roots', format('root chunk {} is no document', n), format('root chunk {} has depth 2', n), format('chunk {} has parent 0 but is in the child chain of {}', n, n - 1),
        format('chunk {} reachable via multiple paths', n)]) from s
    union all select id, 'root kind', 'CHNK', 'root chunk 1 is no document' from s
    union all select page_id, 'root kind', 'CHNK', format('chunk {}: {} in table_cell', chunk_id, kind) from c where parent_id = 1 and kind like 'heading%'
    union all select id, unnest(['depth', 'parent', 'parent', 'shape', 'own next', 'own next', 'prev', 'child', 'child', 'child', 'last child', 'wrong chain', 'wrong chain']), 'CHNK',
        unnest([format('chunk {} has depth 7 below 1', n), format('chunk {} has dangling parent {}', n, n + 7), format('chunk {} has parent {} but is in the child chain of {}', n, n + 7, n - 1), format('chunk {}: table in paragraph', n),
        format('chunk {} is its own next sibling', n), format('sibling chain cycle under chunk {}', n - 1), format('chunk {} prev 1 inconsistent in chain of {}', n, n - 1),
        format('chunk {} has dangling child {}', n - 1, n + 9), format('chunk {} last_child {} != chain end 0', n - 1, n), format('chunk {} unreachable from the root', n),
        format('chunk {} last_child 1 != chain end {}', n - 1, n), 'chunk 2 in wrong chain', 'chunk 2 reachable via multiple paths']) from s
    union all select id, unnest(['font', 'font', 'font', 'no atlas', 'no atlas', 'no atlas', 'no atlas']), unnest(['STYL', 'STYL', 'STYL', 'STYL', 'STYL', 'STYL', 'GLYF']),
        unnest(['style 4 references font_id 1 but there are 1 atlases', 'style 6 references font_id 1 but there are 1 atlases', 'style 7 references font_id 1 but there are 1 atlases', 'style 4 references font_id 1 but there are 0 atlases',
        'style 6 references font_id 1 but there are 0 atlases', 'style 7 references font_id 1 but there are 0 atlases', 'document contains text but no glyph atlas']) from s
    union all select id, unnest(['image length', 'image']), 'CONT', unnest(['payload 0 image_ref has wrong length', 'payload 0 references image 5 but there are 0 images']) from s
    union all select page_id, 'link', 'CHNK', format('extra link_target of chunk {} is malformed', chunk_id) from c where kind = 'run' and depth = 4
    union all select id, unnest(['cut', 'magic', 'end']), 'PACKAGE', unnest(['too_short', 'bad_magic', 'out_of_bounds: section 7']) from s)
    select id as page_id, way, section, message from i"""
)
def broken_packages(spark, sf_dir):
    """V1 to V17, JN5 to JN10: all packages broken in each of thirty ways, and what is said of each."""
    source = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))
    with scope() as spare:
        made = spare(written(packages.pack(pages(spark, sf_dir), source).select("doc_id", "bytes"), "packed"))
    atlas = "named_struct('font_id', 0L, 'family', 'f', 'weight', 400, 'italic', false, 'glyphs', 0, 'kerning', 0, 'pages', 0, 'page_bytes', 0L)"
    sound = packages.unpack(made).withColumn("atlases", F.expr(f"array({atlas}, {atlas})")).withColumn("info", F.col("info").withField("atlas_count", F.lit(2).cast("long")))
    sound = written(sound, "sound")
    size = F.octet_length("bytes")
    ways = breaks(sound.schema["info"].dataType)
    spoilt = {"cut": F.substring("bytes", 1, 10), "magic": F.concat(F.lit(b"PULL"), F.expr("substring(bytes, 5)")), "end": F.substring(F.col("bytes"), F.lit(1), size - 1)}
    spoilt = {way: {"bytes": data} for way, data in spoilt.items()}
    # ids of several packages in one table: the page's id and the way's number. None is written: a package is broken as it is checked
    rows = broken(spread(sound), ways, 0).unionByName(packages.unpack(broken(made, spoilt, len(ways))))
    said = packages.validate(None, rows)
    names = F.array(*map(F.lit, [*ways, *spoilt]))
    return said.select(F.floor(F.col("doc_id") / 100).cast("long").alias("page_id"), F.get(names, F.pmod(F.col("doc_id"), F.lit(100)).cast("int")).alias("way"), "section", "message")


# What was Python alone: white space, paragraphs, encoded sections, checksums, as expressions, windows and joins.


@query("with " + SEGMENTS + "select page_id, string_agg(t, '' order by k) as text, count(*) as leaves from texts where t <> '' group by page_id")
def folded_text(spark, sf_dir):
    """WN6, FS3: each page's text with its white space folded, by windows over the leaves of its tree as read."""
    source = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("kind"), F.col("html").alias("source"))
    leaves = flow.folded(written(flow.raw(source), "raw"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "")
    return leaves.groupBy(F.col("doc_id").alias("page_id")).agg(text.alias("text"), F.count("*").alias("leaves"))


@query(f"with {PLACED} select page_id, (row_number() over (partition by page_id order by i))::int as place, t as text from n where r <> 2")
def page_paragraphs(spark, sf_dir):
    """WN11, WN12, TR3: the paragraphs of each page, named and implied ones, by islands over the rows of its tree."""
    p = flow.paragraphs(pages(spark, sf_dir).nodes)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("node_id"))
    return p.select(F.col("doc_id").alias("page_id"), place.alias("place"), "text")


def _le(x: str, size: int) -> str:
    digits = f"printf('%0{2 * size}x', ({x})::bigint)"
    return " || ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in reversed(range(size)))


def _styles() -> str:
    """The section of styles that all test pages have, in hex digits."""
    rows = {k: b"" for k in range(8)}
    count = dict.fromkeys(rows, 0)
    layout = {1: "<HI", 2: "<Hf", 4: "<HH", 8: "<Hf", 9: "<Hf", 12: "<HB", 14: "<HB"}
    for row in STYLE_ROWS.replace("::float::double", "").split("),"):
        style, tag, _, value = (x.strip(" ()'\n") for x in row.split(","))
        value = float(value)
        rows[int(style)] += struct.pack(layout[int(tag)], int(tag), value if layout[int(tag)][-1] == "f" else int(value))
        count[int(style)] += 1
    return (struct.pack("<I", 8) + b"".join(struct.pack("<IHH", k, count[k], len(v)) + v for k, v in rows.items())).hex()


@query(
    f"""with cc as ({ORACLES["compiled_chunks"]}), kinds as (select unnest({list(CHUNK_CODES)!r}) as kind, unnest({list(CHUNK_CODES.values())!r}) as code),
    h as (select doc_id, count(*) as n, string_agg({_le("chunk_id", 4)} || {_le("code", 1)} || {_le("flags", 1)} || '0000' || {" || ".join(_le(x, 4) for x in package_files.LINKS)}, '' order by chunk_id) as x
          from cc join kinds using (kind) group by doc_id),
    u as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as u, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) as i from pages),
    e as (select page_id, count(*) as n, string_agg({_le("3 * i + 2", 4)} || '0100' || {_le("strlen(u) + 2", 2)} || {_le("strlen(u)", 2)} || hex(u), '' order by i) as x from u group by page_id),
    t as (select distinct doc_id, content_index - 1 as k, text from cc where content_index > 0),
    p as (select doc_id, count(*) as n, string_agg({_le("k", 4)} || '00000000' || {_le("strlen(text)", 4)} || hex(text), '' order by k) as x from t group by doc_id),
    s as (select h.doc_id, {_le("h.n", 4)} || h.x || {_le("coalesce(e.n, 0)", 4)} || coalesce(e.x, '') as chnk, '{_styles()}' as styl, {_le("coalesce(p.n, 0)", 4)} || coalesce(p.x, '') as cont
          from h left join e on h.doc_id = e.page_id left join p on h.doc_id = p.doc_id)
    select doc_id as page_id, sha256(unhex(chnk)) as chnk, sha256(unhex(styl)) as styl, sha256(unhex(cont)) as cont, substr(sha256(unhex(chnk || styl || cont || '00000000')), 1, 32) as document_id from s"""
)
def section_digests(spark, sf_dir):
    """AG14, AG16, JN13: digests of the sections that each page's package will hold, and the id over all of them, from the tables alone."""
    c = pages(spark, sf_dir)
    s = written(digests.sections(c), "sections")
    whole = F.substring(F.sha2(F.concat("chnk", "styl", "cont", F.unhex(F.lit("00000000"))), 256), 1, 32)
    return s.select(F.col("doc_id").alias("page_id"), *[F.sha2(x, 256).alias(x) for x in ("chnk", "styl", "cont")], whole.alias("document_id"))


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (POLYNOMIAL if k & 1 else 0)
        out.append(k)
    return out


@query(
    rf"""with d as (select doc_id, coalesce(text, '') as t, hex(coalesce(text, '')) as h from documents),
    b as (select doc_id, list_transform(range(1, length(h), 2), lambda k: ('0x' || substr(h, k, 2))::bigint) as b from d),
    c as (select doc_id, len(b)::bigint as size, coalesce(list_sum(b), 0)::bigint as s, coalesce(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))), 0)::hugeint as r,
          list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, ({_crc_table()!r})[(xor(c, x) & 255) + 1]::bigint)) as crc from b)
    select doc_id, size, ((r + size) % 65521 * 65536 + (s + 1) % 65521)::bigint as adler32, xor(crc, 4294967295::bigint) as crc32 from c"""
)
def piece_checksums(spark, sf_dir):
    """AG17, AG18: checksums of all texts, from pieces of 512 bytes that are summed apart."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / 512)).cast("int")
    cut = d.select("doc_id", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    pieces = cut.select("doc_id", (F.col("k") * 512).cast("long").alias("offset"), F.substring(F.col("data"), F.col("k") * 512 + 1, F.lit(512)).alias("piece"))
    return checksums.checksums(pieces, ["doc_id"], "offset", "piece")


# Faces: the tables have the shape of fonts' character maps and pair adjustments; what they hold comes from the test tables.


@query(
    """with d as (select coalesce(lang, 'und') as face, doc_id, unnest(list_distinct(string_split(text, ''))) as c from documents where text <> ''),
    w as (select face, unicode(c)::bigint as cp, count(*) as docs from d group by face, unicode(c)),
    m as (select face, cp, 9 + row_number() over (partition by face order by cp) as glyph from w where docs >= 20),
    s as (select cp, 9 + row_number() over (order by cp) as glyph from (select distinct unicode(c)::bigint as cp from (select unnest(string_split(html, '')) as c from pages)))
    select w.face, w.cp, w.docs, case when m.cp is not null then -1 when s.cp is not null then 0 end::bigint as source, coalesce(m.glyph, s.glyph)::bigint as glyph
    from w left join m on w.face = m.face and w.cp = m.cp left join s on w.cp = s.cp"""
)
def glyph_sources(spark, sf_dir):
    """JN11, ST3, AG11: the glyph that shows each codepoint of each language's texts, of a face that holds what twenty texts have, a supplementary one that holds what pages have, or none."""
    split = lambda t: F.explode(F.array_distinct(F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("long"))))
    d = table(spark, sf_dir, "documents").where("text <> ''")
    used = d.select(F.coalesce("lang", F.lit("und")).alias("face"), split(F.col("text")).alias("cp")).groupBy("face", "cp").agg(F.count("*").alias("docs"))
    used = written(used, "used")
    number = lambda df, group: df.withColumn("glyph", 9 + F.row_number().over(W.partitionBy(*group).orderBy("cp")))
    maps = glyphs.intervals(number(used.where("docs >= 20").select("face", "cp"), ["face"]), ["face"], "cp", "glyph")
    more = table(spark, sf_dir, "pages").select(split(F.col("html")).alias("cp")).distinct().withColumn("ord", F.lit(0))
    more = glyphs.intervals(number(more, ["ord"]), ["ord"], "cp", "glyph")
    return used.join(glyphs.mapped(used, maps, more), ["face", "cp"])


@query(
    """with u as (select distinct l_returnflag as face, p_partkey as glyph, p_partkey + 100 as cp from lineitem join part on l_partkey = p_partkey where p_size <= 25),
    p as (select l_returnflag as face, l_suppkey as l, l_partkey as r, sum(l_quantity::bigint - 25) as adjust from lineitem group by all)
    select p.face, a.cp as left_cp, b.cp as right_cp, p.adjust::bigint as adjust from p join u a on p.face = a.face and p.l = a.glyph join u b on p.face = b.face and p.r = b.glyph where p.adjust <> 0"""
)
def kerning_pairs(spark, sf_dir):
    """JN12, AG23: pair adjustments added up over lookups, for pairs whose ends a face uses."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "face")
    part = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("glyph"), (F.col("p_partkey") + 100).alias("cp"))
    used = items.select("face", F.col("l_partkey").alias("glyph")).distinct().join(part, "glyph")
    pairs = items.select("face", F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right"), (F.col("l_quantity").cast("long") - 25).alias("adjust"))
    return glyphs.kerned(used, pairs).withColumnsRenamed({"left": "left_cp", "right": "right_cp"})


# Parts as pages of a catalogue: values of the table in style attributes, lists, spans, pictures and links.

CATALOG = """<title>%(name)s</title><style>#sku { color: #abc; text-align: end } .big { background-color: TEAL; margin-bottom: 3pt } h2.big, p.none { list-style-type: upper-roman } h3 { color: red } #none { color: red }</style>
<h2 id=sku class="big" style="font-family: serif, 'My %(brand)s', x; line-height: %(size)s%%; letter-spacing: normal; font: bold">%(name)s</h2>
<p class="size" style="text-indent: %(size)spx; margin-top: 0.5em; font-size: %(size)spx; white-space: pre-line; font-style: oblique; text-decoration: underline; font-weight: bolder; color: #12345678; line-height: 24px">%(type)s</p>
<ol start=%(size)s><li>%(brand)s<li>%(name)s</ol><table><tr><td colspan=2>%(type)s<td rowspan=%(size)s>%(key)s</table><p><a href="/part/%(key)s">%(name)s</a><img src="%(brand)s.png" alt="%(name)s">"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    fields = {"name": "p_name", "brand": "p_brand", "size": "p_size", "type": "p_type", "key": "p_partkey"}
    order = re.findall(r"%\((\w+)\)s", CATALOG)
    html = F.format_string(re.sub(r"%\(\w+\)s", "%s", CATALOG), *[F.col(fields[x]).cast("string") for x in order])
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit("html").alias("kind"), html.alias("source"), "p_name", "p_size")


@query(
    """with p as (select p_partkey as doc_id, p_brand, greatest(1, p_size)::double as s, p_size::double as size from part)
    select doc_id, 'h2' as tag, 'My ' || p_brand as font_family, 24.0::double as font_size_px, size as line_height, 700 as font_weight, false as italic, 2864434431 as color, 8421631 as background,
    19.92::float::double as margin_top, 4.0::double as margin_bottom, 2 as text_align, 0.0::double as text_indent, 8 as list_style, false as code, false as underline, 0.0::double as letter_spacing, 0 as white_space from p
    union all select doc_id, 'p', 'Noto Sans', s, 24.0, 700, true, 305419896, 0, 0.5 * s, s, 0, size, 0, false, true, 0.0, 1 from p"""
)
def catalog_styles(spark, sf_dir):
    """FIL7, FC1 to FC6, FC9, JN2, TR6: what a heading known by its id and a paragraph of a class come to, from sheets and style attributes."""
    c = Corpus(catalog(spark, sf_dir))
    asked = c.requests.where("id = 'sku' or array_contains(classes, 'size')").select("doc_id", "request", "tag")
    s = asked.join(c.computed.drop("seq", "marks"), ["doc_id", "request"]).drop("request").distinct()
    return s.select(*[F.col(f).cast("double").alias(f) if t == "float" else F.col(f) for f, t in s.dtypes])


@query(
    """select p_partkey as doc_id, unnest(['list_item_value', 'list_item_value', 'cell_span', 'cell_span', 'link_target', 'image_alt']) as kind,
    unnest([null, null, null, null, '/part/' || p_partkey, p_name]) as text, unnest([p_size, p_size + 1, 2, 1, null, null])::bigint as a, unnest([null, null, 1, greatest(1, p_size), null, null])::bigint as b from part
    where p_size <> 1 union all
    select p_partkey, unnest(['list_item_value', 'list_item_value', 'cell_span', 'link_target', 'image_alt']), unnest([null, null, null, '/part/' || p_partkey, p_name]), unnest([1, 2, 2, null, null])::bigint, unnest([null, null, 1, null, null])::bigint
    from part where p_size = 1"""
)
def catalog_extras(spark, sf_dir):
    """AG5, WN5, FS6: numbers of list items, spans of cells, targets of links and texts of pictures."""
    return Corpus(catalog(spark, sf_dir), keep=False).extras.select("doc_id", "kind", "text", "a", "b")


@query(
    """with t as (select p_partkey as doc_id, unnest(list_distinct([p_name, p_brand, p_type, p_partkey::varchar])) as t from part),
    b as (select doc_id, count(*) as n, sum(strlen(t)) as bytes from t group by doc_id), g as (select p_partkey as doc_id, p_size, len(list_distinct(string_split(p_name, ''))) as glyphs from part),
    k as (select doc_id, unnest(['chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'chunks', 'extras', 'extras', 'extras', 'extras', 'content', 'content', 'content', 'atlas glyphs', 'atlas page bytes', 'images', 'images', 'seal']) as topic,
    unnest(['document', 'heading2', 'paragraph', 'list', 'list_item', 'table', 'table_row', 'table_cell', 'image', 'run', 'list_item_value', 'cell_span', 'link_target', 'image_alt', 'texts', 'text bytes', 'image references', '0', '0', 'images', 'pixels', 'sections covered']) as name,
    unnest([1, 1, 6, 1, 2, 1, 1, 2, 1, 7, 2, case when p_size = 1 then 1 else 2 end, 1, 1, n, bytes, 1, glyphs, 1024, 1, 2 * p_size, 6])::bigint as n from b join g using (doc_id))
    select * from k"""
)
def catalog_report(spark, sf_dir):
    """SNK3, AG4 to AG9: reports of packages with an atlas and a picture each; sections' sizes and the number of properties are in other rows."""
    docs = catalog(spark, sf_dir)
    cps = F.array_sort(F.array_distinct(F.transform(F.split("p_name", ""), lambda c: F.ascii(c).cast("long"))))
    glyph = lambda c: F.struct(c.alias("codepoint"), *[F.lit(0.5).cast("float").alias(x) for x in ("advance", "bearing_x", "bearing_y")], *[F.lit(v).alias(x) for x, v in (("box_x", 0), ("box_y", 0), ("box_w", 1), ("box_h", 1), ("page_index", 0), ("flags", 0))])
    metrics = [F.lit(1.0).cast("float").alias(x) for x in ("ascent", "descent", "line_gap", "cap_height", "x_height", "units_per_em")]
    page = F.unhex(F.repeat(F.lit("00"), 16 * 16 * 4))
    atlas = F.struct(F.lit(0).alias("font_id"), F.lit(4).alias("padding"), F.lit(40960).cast("long").alias("texels_per_em"), *metrics, F.lit("f").alias("family"), F.lit(400).alias("weight"), F.lit(False).alias("italic"), F.lit(16).alias("page_width"), F.lit(16).alias("page_height"), F.transform(cps, glyph).alias("glyphs"), F.array().cast("array<struct<left: bigint, right: bigint, adjust: float>>").alias("kerning"), F.array(page).alias("pages"))
    atlases = docs.select("doc_id", F.lit(0).alias("font_id"), atlas.alias("atlas"))
    images = docs.select("doc_id", F.lit(0).alias("image_id"), F.col("p_size").alias("width"), F.lit(2).alias("height"), F.lit("rgb8").alias("format"), F.unhex(F.expr("repeat('7f', p_size * 6)")).alias("data"))
    made = packages.pack(Corpus(docs), docs, atlases, images)
    return packages.inspect(None, written(packages.unpack(made), "unpacked")).where("topic not like 'section %' and topic <> 'styles'")


@query(
    """select page_id, 'link in list_item' as issue, len(regexp_extract_all(html, '<li><a '))::bigint as n from pages where contains(html, '<li><a ')
    union all select page_id, 'strong in document', 1::bigint from pages where contains(html, '<p><b>') and not contains(html, '</b>')"""
)
def tree_violations(spark, sf_dir):
    """FIL5, TR4: nodes of all pages that stand where their kind may not, are too deep or too many, or aren't in NFC."""
    found = tree_issues(pages(spark, sf_dir).nodes)
    return found.groupBy(F.col("doc_id").alias("page_id"), "issue").agg(F.count("*").alias("n"))


@query("select p_partkey as doc_id, unnest([p_size, p_size + 1])::bigint as value from part")
def catalog_numbers(spark, sf_dir):
    """WN5: the numbers of list items, from the rows of the trees alone."""
    # lists and items are two views of the nodes: written, so that one parse serves both
    n = Corpus(catalog(spark, sf_dir), keep=False).nodes.select("doc_id", "node_id", "parent_id", "kind", "list_start")
    return flow.list_values(written(n, "nodes")).select("doc_id", "value")


@query(
    """select l_orderkey, count(*)::int as n, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 9) as rmse, round(max(abs(l_discount - l_tax)), 9) as worst from lineitem group by l_orderkey"""
)
def mask_error(spark, sf_dir):
    """AG20, AT13: how far two arrays are apart, as atlases.field_errors compares masks."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_tax"))).alias("x"))
    e = masks.error(F.transform("x", lambda y: y["l_discount"]), F.transform("x", lambda y: y["l_tax"]))
    return d.select("l_orderkey", F.size("x").alias("n"), F.round(e["rmse"], 9).alias("rmse"), F.round(e["worst"], 9).alias("worst"))

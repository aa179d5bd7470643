"""Queries over layout, markup and the knowledge graph; elements are derived from lines and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import similarity as Sim
from loomwork.functions import text as T
from loomwork.operators import folds, graph, layout, markup
from loomwork.plans.registry import query
from loomwork.plans.text import _CHUNK, _ELEMENTS, _JUNK, _LINES, lines, prefixed_lines


#: Pages of twenty elements in two columns of 800 x 1000; some have wide boxes above, below or throughout.  One header of some
#: documents is a reference title.
def boxes(read):
    seq, doc = F.col("seq"), F.col("doc_id")
    place = seq % 20
    wide = ((doc % 4 == 0) & (place < 4)) | ((doc % 5 == 1) & (place >= 14)) | (doc % 7 == 3)
    title = (seq == 28) & (doc % 3 == 0)
    return prefixed_lines(read).select(
        "doc_id", F.floor(seq / 20).cast("int").alias("page"), seq.cast("int").alias("index"), F.when(title, "References").otherwise(F.col("line")).alias("text"), "kind",
        F.when(wide, 60).when(seq % 3 == 0, 40).otherwise(420).cast("int").alias("left"), (place * 50).cast("int").alias("top"),
        F.when(wide, 700).when(seq % 3 == 0, 380).otherwise(760).cast("int").alias("right"), (place * 50 + 40).cast("int").alias("bottom"),
    )


_WIDE = "(doc_id % 4 = 0 AND seq % 20 < 4 OR doc_id % 5 = 1 AND seq % 20 >= 14 OR doc_id % 7 = 3)"
_BOX = f"""SELECT doc_id, (seq // 20)::INT AS page, seq::INT AS index, CASE WHEN seq = 28 AND doc_id % 3 = 0 THEN 'References' ELSE line END AS text, kind,
    (CASE WHEN {_WIDE} THEN 60 WHEN seq % 3 = 0 THEN 40 ELSE 420 END)::INT AS l, ((seq % 20) * 50)::INT AS t,
    (CASE WHEN {_WIDE} THEN 700 WHEN seq % 3 = 0 THEN 380 ELSE 760 END)::INT AS r, ((seq % 20) * 50 + 40)::INT AS b FROM ({_ELEMENTS})"""
#: Borders of the free slice around three rows of each page, then the zones of the first rule that holds.
_ZONES = f"""WITH box AS ({_BOX}), page AS (SELECT doc_id, page, min(t) AS y0, max(b) AS y1 FROM box GROUP BY ALL),
    probe AS (SELECT doc_id, page, y0, y1, unnest(['half', 'quarter', 'three']) AS name, unnest([(y0 + y1) // 2, trunc(y0 + (y1 - y0) * 0.25)::INT, trunc(y0 + (y1 - y0) * 0.75)::INT]) AS m FROM page),
    edge AS (SELECT doc_id, page, name, any_value(y0) AS y0, any_value(y1) AS y1,
        CASE WHEN bool_or(x AND t <= m AND b >= m) THEN any_value(m) ELSE coalesce(max(b) FILTER (x AND b < m), any_value(y0)) END AS up,
        CASE WHEN bool_or(x AND t <= m AND b >= m) THEN any_value(m) ELSE coalesce(min(t) FILTER (x AND t > m), any_value(y1)) END AS down
        FROM (SELECT *, r >= 390 AND l <= 410 AS x FROM probe JOIN box USING (doc_id, page)) GROUP BY ALL),
    wide AS (SELECT doc_id, page, bool_or(l < 410 AND r > 390) AS crossed FROM box GROUP BY ALL),
    e AS (SELECT doc_id, page, y0, y1, crossed, max(up) FILTER (name = 'half') AS hu, max(down) FILTER (name = 'half') AS hd, max(up) FILTER (name = 'quarter') AS qu,
        max(down) FILTER (name = 'quarter') AS qd, max(up) FILTER (name = 'three') AS tu, max(down) FILTER (name = 'three') AS td FROM edge JOIN wide USING (doc_id, page) GROUP BY ALL),
    candidate AS (
        SELECT doc_id, page, 1 AS rule, 'TWO_COLUMN' AS layout, unnest([0, 1]) AS seq, unnest(['LEFT', 'RIGHT']) AS zone, unnest([0, 410]) AS zl, y0 AS zt, unnest([390, 800]) AS zr, y1 AS zb, NOT crossed AS fits, true AS must FROM e
        UNION ALL SELECT doc_id, page, 2, 'TWO_COLUMN_BORDER', unnest([0, 1]), unnest(['LEFT', 'RIGHT']), unnest([0, 410]), hu, unnest([390, 800]), hd, hu <= y0 + (y1 - y0) * 0.15 AND hd >= y1 - (y1 - y0) * 0.15, false FROM e
        UNION ALL SELECT doc_id, page, 3, 'INVERTED_T', unnest([0, 1, 2]), unnest(['LEFT_UP', 'RIGHT_UP', 'LOW']), unnest([0, 410, 0]), unnest([qu, qu, qd]), unnest([390, 800, 800]), unnest([qd, qd, 1000]), qu <= y0 + (y1 - y0) * 0.15, true FROM e
        UNION ALL SELECT doc_id, page, 4, 'T', unnest([0, 1, 2]), unnest(['UP', 'LEFT_LOW', 'RIGHT_LOW']), unnest([0, 0, 410]), unnest([0, tu, tu]), unnest([800, 390, 800]), unnest([tu, td, td]), td >= y1 - (y1 - y0) * 0.15, true FROM e
        UNION ALL SELECT doc_id, page, 5, 'DEFAULT', 0, 'DEFAULT', 0, 0, 800, 1000, true, false FROM e),
    held AS (SELECT c.doc_id, c.page, rule, c.seq, bool_or(l >= zl AND r <= zr AND t >= zt AND b <= zb) AS one FROM candidate c JOIN box USING (doc_id, page) GROUP BY ALL),
    rule AS (SELECT doc_id, page, min(rule) AS rule FROM (SELECT doc_id, page, rule FROM candidate JOIN held USING (doc_id, page, rule, seq) GROUP BY ALL HAVING bool_and(fits) AND bool_and(one OR NOT must)) GROUP BY ALL),
    zones AS (SELECT doc_id, page, layout, seq, zone, zl, zt, zr, zb FROM candidate JOIN rule USING (doc_id, page, rule)),
    inside AS (SELECT box.*, zones.seq, zone FROM box JOIN zones USING (doc_id, page) WHERE l >= zl - 10 AND t >= zt - 10 AND r <= zr + 10 AND b <= zb + 10)"""


def _zones(read):
    return layout.layout_of_pages(boxes(read), ["doc_id", "page"], 800, 1000)


def _inside(read):
    return layout.contained(boxes(read), _zones(read), ["doc_id", "page"], 10, ["seq"])


@query("layout_cascade", f"{_ZONES} SELECT doc_id, page, layout, seq::INT AS seq, zone, zl::INT AS l, zt::INT AS t, zr::INT AS r, zb::INT AS b FROM zones")
def layout_cascade(read):
    return _zones(read).withColumnsRenamed({"left": "l", "top": "t", "right": "r", "bottom": "b"})


@query("zone_containment", f"{_ZONES} SELECT doc_id, page, zone, count(*) AS n FROM inside GROUP BY ALL")
def zone_containment(read):
    return _inside(read).groupBy("doc_id", "page", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("zone_containment_exact", f"{_ZONES} SELECT doc_id, page, zone, count(*) AS n FROM box JOIN zones USING (doc_id, page) WHERE l >= zl AND t >= zt AND r <= zr AND b <= zb GROUP BY ALL")
def zone_containment_exact(read):
    return layout.contained(boxes(read), _zones(read), ["doc_id", "page"]).groupBy("doc_id", "page", "zone").agg(F.count(F.lit(1)).alias("n"))


_JUNK_TEXT, _CHUNK_TEXT = _JUNK.replace("line", "text"), _CHUNK.replace("line", "text")
_JOINED = r"regexp_replace(text, '([\p{L}\p{M}\p{Nd}\p{Pc}]+)- ([\p{L}\p{M}\p{Nd}\p{Pc}]+)', '\1\2', 'g')"
#: From elements ``part`` with zones: paragraphs of each zone, with what is carried on.
_PARAGRAPHS = f"""kept AS (SELECT *, CASE WHEN zone = 'DEFAULT' THEN -((r - 800) ** 2 + (b - 1000) ** 2) ELSE b END AS far FROM part WHERE NOT {_JUNK_TEXT}),
    ends AS (SELECT doc_id, page, seq, zone, max(index) AS last, arg_max(kind, index) AS k, arg_max(text, index) AS x, min(index) FILTER (far = best) AS lowest
        FROM (SELECT *, max(far) OVER (PARTITION BY doc_id, page, seq) AS best FROM kept) GROUP BY ALL),
    carried AS (SELECT doc_id, page, seq, zone, CASE WHEN last = lowest AND k = 'Text' AND NOT ends_with(x, '.') THEN last END AS cut FROM ends),
    texts AS (SELECT doc_id, page, seq, zone, list({_JOINED} ORDER BY index) FILTER (index IS DISTINCT FROM cut AND {_CHUNK_TEXT}) AS paragraphs, max({_JOINED}) FILTER (index = cut) AS last_fragment
        FROM kept JOIN carried USING (doc_id, page, seq, zone) GROUP BY ALL),
    result AS (SELECT doc_id, page, seq, zone, CASE WHEN zone NOT IN ('UP', 'LOW') THEN coalesce(paragraphs, []) END AS paragraphs, CASE WHEN zone NOT IN ('UP', 'LOW') THEN last_fragment END AS last_fragment
        FROM (SELECT DISTINCT doc_id, page, seq, zone FROM part) LEFT JOIN texts USING (doc_id, page, seq, zone))"""
_DIGESTED = "doc_id, page, seq::INT AS seq, zone, len(paragraphs)::BIGINT AS n_paragraphs, md5(array_to_string(paragraphs, chr(10))) AS paragraphs, md5(last_fragment) AS last_fragment"


def _digested(z):
    digest = F.md5(F.array_join("paragraphs", "\n"))
    return z.select("doc_id", "page", F.col("seq").cast("int").alias("seq"), "zone", F.when(F.col("paragraphs").isNotNull(), F.size("paragraphs")).cast("long").alias("n_paragraphs"), digest.alias("paragraphs"), F.md5("last_fragment").alias("last_fragment"))


@query("zone_paragraphs", f"{_ZONES}, part AS (SELECT * FROM inside), {_PARAGRAPHS} SELECT {_DIGESTED} FROM result")
def zone_paragraphs(read):
    return _digested(layout.zone_paragraphs(_inside(read), ["doc_id", "page", "seq"], 800, 1000))


_POST = f"""{_ZONES}, titles AS (SELECT doc_id, min(index) AS title FROM box WHERE kind = 'Section header' AND upper(text) = 'REFERENCES' GROUP BY doc_id HAVING count(*) = 1),
    start AS (SELECT doc_id, min((page, seq, index)) AS s FROM inside JOIN titles USING (doc_id) WHERE index = title GROUP BY doc_id),
    stop AS (SELECT doc_id, min((page, seq, index)) AS e FROM inside JOIN start USING (doc_id) WHERE kind = 'Section header' AND (page, seq, index) > s GROUP BY doc_id),
    marked AS (SELECT inside.*, s, e FROM inside LEFT JOIN start USING (doc_id) LEFT JOIN stop USING (doc_id)),
    part AS (SELECT * FROM marked WHERE s IS NULL OR (page, seq, index) < s AND NOT (e IS NOT NULL AND s[1] = e[1] AND s[2] = e[2] AND page = s[1] AND seq = s[2]))"""


@query("pdf_paragraphs", f"{_POST}, {_PARAGRAPHS} SELECT {_DIGESTED} FROM result")
def pdf_paragraphs(read):
    return _digested(layout.postprocessed(boxes(read), _zones(read), "doc_id", 800, 1000)[0])


@query("pdf_references", f"{_POST} SELECT doc_id, count(*) AS n_references, md5(string_agg({_JOINED}, chr(10) ORDER BY page, seq, index)) AS digest FROM marked WHERE (page, seq, index) > s AND (e IS NULL OR (page, seq, index) < e) AND NOT {_JUNK_TEXT} GROUP BY doc_id")
def pdf_references(read):
    refs = layout.postprocessed(boxes(read), _zones(read), "doc_id", 800, 1000)[1]
    return refs.select("doc_id", F.size("references").cast("long").alias("n_references"), F.md5(F.array_join("references", "\n")).alias("digest"))


@query(
    "reference_title",
    f"SELECT doc_id, CASE WHEN count(*) FILTER (kind = 'Section header' AND upper(text) = 'REFERENCES') = 1 THEN min(index) FILTER (kind = 'Section header' AND upper(text) = 'REFERENCES') ELSE -1 END AS place FROM ({_BOX}) GROUP BY doc_id",
)
def reference_title(read):
    return layout.reference_title(boxes(read), ["doc_id"])


@query(
    "nearest_box",
    f"""WITH c AS (SELECT *, r >= 390 AND l <= 410 AS x FROM ({_BOX}))
    SELECT doc_id, page, (CASE WHEN bool_or(x AND t <= 500 AND b >= 500) THEN 500 ELSE coalesce(max(b) FILTER (x AND b < 500), 7) END)::INT AS up,
    (CASE WHEN bool_or(x AND t <= 500 AND b >= 500) THEN 500 ELSE coalesce(min(t) FILTER (x AND t > 500), 993) END)::INT AS down FROM c GROUP BY ALL""",
)
def nearest_box(read):
    return layout.nearest_edges(boxes(read), ["doc_id", "page"], 390, 410, 500, 7, 993)


@query(
    "references_section",
    f"""WITH l AS (SELECT *, kind = 'Section header' AS h FROM ({_LINES})), t AS (SELECT doc_id, CASE WHEN max(seq) FILTER (h) >= 14 THEN 14 END AS s FROM l GROUP BY doc_id),
    u AS (SELECT l.doc_id, s, min(seq) FILTER (h AND seq > s) AS e FROM l JOIN t USING (doc_id) GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (seq > s AND (e IS NULL OR seq < e)) AS n_references FROM l JOIN u USING (doc_id) GROUP BY doc_id""",
)
def references_section(read):
    """The third header stands for the reference title."""
    header = F.col("kind") == "Section header"
    marked = folds.reference_section(lines(read), "doc_id", "seq", header & (F.col("seq") == 14), header)
    return marked.groupBy("doc_id").agg(F.count_if("in_references").alias("n_references"))


_CHAPTER = f"SELECT doc_id, (seq // 3)::BIGINT AS seq, CASE (seq // 3) % 5 WHEN 3 THEN 'FIGURE' WHEN 4 THEN 'INTRODUCTION' ELSE 'DEFAULT' END AS kind, any_value(line) FILTER (seq % 3 = 0) AS header, list(line ORDER BY seq) AS parts FROM ({_LINES}) GROUP BY ALL"


@query(
    "chapter_merge",
    f"""WITH RECURSIVE c AS (SELECT *, '## ' || header || chr(10) || chr(10) || array_to_string(parts, chr(10)) AS alone, '## ' || header || chr(10) || chr(10) || array_to_string(parts, ' ') AS taken FROM ({_CHAPTER}) WHERE kind <> 'FIGURE'),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM c WHERE kind = 'DEFAULT'),
    walk AS (SELECT doc_id, k, seq AS head, length(alone) AS n FROM d WHERE k = 1
        UNION ALL SELECT d.doc_id, d.k, CASE WHEN n < 500 THEN head ELSE seq END, CASE WHEN n < 500 THEN n + 2 + length(alone) ELSE length(alone) END FROM walk JOIN d ON d.doc_id = walk.doc_id AND d.k = walk.k + 1),
    owned AS (SELECT d.doc_id, d.seq, head, CASE WHEN d.seq = head THEN alone ELSE taken END AS text FROM d JOIN walk USING (doc_id, k) UNION ALL SELECT doc_id, seq, seq, alone FROM c WHERE kind <> 'DEFAULT')
    SELECT doc_id, head AS seq, md5(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS digest, length(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS n_chars FROM owned GROUP BY doc_id, head""",
)
def chapter_merge(read):
    """Chapters of three lines, the first of which is their header too."""
    number = F.floor(F.col("seq") / 3)
    kind = F.when(number % 5 == 3, "FIGURE").when(number % 5 == 4, "INTRODUCTION").otherwise("DEFAULT")
    parts = F.sort_array(F.collect_list(F.struct("seq", "line")))
    chapters = lines(read).groupBy("doc_id", number.alias("number"), kind.alias("kind")).agg(parts.alias("x")).select("doc_id", "number", "kind", F.transform("x", lambda x: x["line"]).alias("parts"))
    merged = folds.merged_chapters(chapters.withColumn("header", F.get("parts", F.lit(0))), "doc_id", "number", "kind", "header", "parts", 500)
    return merged.select(F.col("doc").alias("doc_id"), "seq", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


_CLEAN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"


def _element(tag: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract({_CLEAN}, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '')"


@query("html_fields", rf"""SELECT page_id, {_element('title')} AS title, {_element('h1')} AS heading, nullif(regexp_extract({_CLEAN}, '(?is)<html\b[^>]*\blang="([^"]*)"', 1), '') AS lang FROM pages""")
def html_fields(read):
    return read("pages").select("page_id", markup.element_text("html", "title").alias("title"), markup.element_text("html", "h1").alias("heading"), markup.attribute("html", "html", "lang").alias("lang"))


@query("html_links", rf"""SELECT page_id, unnest(l) AS link, (generate_subscripts(l, 1) - 1)::INT AS seq FROM (SELECT page_id, regexp_extract_all({_CLEAN}, '(?is)<a\b[^>]*\bhref="([^"]*)"', 1) AS l FROM pages)""")
def html_links(read):
    return read("pages").select("page_id", F.posexplode(markup.links("html")).alias("seq", "link")).select("page_id", "link", "seq")


@query("html_abstract")
def html_abstract(read):
    b = markup.blocks("html")
    return read("pages").select("page_id", F.array_join(b, "\n\n").alias("abstract"))


@query("link_sources", "SELECT regexp_replace(split_part(url, '/', 3), '[^\\p{L}\\p{N}]', '', 'g') AS key, max(page_id) AS page_id, count(*) AS n FROM pages GROUP BY ALL")
def link_sources(read):
    """Sources by their alphanumeric key; the later of equal keys wins."""
    return read("pages").groupBy(T.alnum_key(T.url_domain("url")).alias("key")).agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


_NAMES = "SELECT DISTINCT r_name AS item, 'region' AS field FROM region UNION SELECT DISTINCT p_name, 'part' FROM part UNION SELECT DISTINCT o_orderpriority, 'priority' FROM orders"


def _vocabulary(read):
    names = (("region", "r_name", "region"), ("part", "p_name", "part"), ("orders", "o_orderpriority", "priority"))
    parts = [read(t).select(F.col(c).alias("item"), F.lit(f).alias("field")) for t, c, f in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("jaro_pairs", f"WITH v AS ({_NAMES}) SELECT a.field, a.item AS x, b.item AS y FROM v a JOIN v b USING (field) WHERE jaro_winkler_similarity(a.item, b.item) >= 0.9")
def jaro_pairs(read):
    return graph.similar_items(_vocabulary(read), 0.9)


@query("jaro_scores", f"WITH v AS ({_NAMES}) SELECT a.field, a.item AS x, b.item AS y, round(jaro_winkler_similarity(a.item, b.item), 6) AS score FROM v a JOIN v b USING (field) WHERE a.item < b.item")
def jaro_scores(read):
    v = _vocabulary(read)
    pairs = v.withColumnRenamed("item", "x").join(v.withColumnRenamed("item", "y"), "field").where("x < y")
    return pairs.select("field", "x", "y", F.round(Sim.jaro_winkler_column("x", "y"), 6).alias("score"))


@query("synonym_merge")
def synonym_merge(read):
    return graph.synonym_groups(_vocabulary(read), 90.0)


_ITEMS = "SELECT DISTINCT o_custkey AS id, 'priority' AS field, o_orderpriority AS item FROM orders UNION SELECT DISTINCT o_custkey, 'status', o_orderstatus FROM orders"
_KG = f"""WITH n AS ({_ITEMS}), s AS (SELECT a.field, a.item AS x, b.item AS y FROM (SELECT DISTINCT field, item FROM n) a JOIN (SELECT DISTINCT field, item FROM n) b USING (field) WHERE jaro_winkler_similarity(a.item, b.item) >= 0.9),
    z AS (SELECT id, field, count(*) AS c FROM n GROUP BY ALL), f AS (SELECT id, count(DISTINCT field) AS k FROM n GROUP BY id),
    m AS (SELECT a.id AS source, b.id AS target, a.field, count(DISTINCT a.item) AS mx, count(DISTINCT b.item) AS my FROM n a JOIN s ON s.field = a.field AND s.x = a.item JOIN n b ON b.field = s.field AND b.item = s.y WHERE a.id < b.id GROUP BY ALL)
    SELECT source, target, round(sum((mx / zx.c + my / zy.c) / 2) / any_value(k), 6) AS score FROM m JOIN z zx ON zx.id = source AND zx.field = m.field JOIN z zy ON zy.id = target AND zy.field = m.field JOIN f ON f.id = source GROUP BY source, target"""


# All customers: edges of nodes follow from classes of equal item sets, so the self join compares classes.
_KG_CLASS = "SELECT id, min(id) OVER (PARTITION BY items) AS class FROM (SELECT id, list(field || '|' || item ORDER BY field, item) AS items FROM n GROUP BY id)"


def _customer_items(read):
    o = read("orders").select(F.col("o_custkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("item")) for f, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"))])).alias("f"))
    return o.select("id", "f.field", "f.item").distinct()


@query("kg_overlap_classes", f"WITH n AS ({_ITEMS}) SELECT id, class FROM ({_KG_CLASS})")
def kg_overlap_classes(read):
    return graph.item_classes(_customer_items(read))


@query("kg_overlap_class_edges", f"WITH n AS ({_ITEMS}), k AS ({_KG_CLASS}), e AS ({_KG}) SELECT DISTINCT a.class AS source, b.class AS target, score FROM e JOIN k a ON a.id = e.source JOIN k b ON b.id = e.target WHERE score >= 0.24")
def kg_overlap_class_edges(read):
    """Edges among all customers, by the classes of ``kg_overlap_classes``."""
    items = _customer_items(read)
    return graph.class_edges(items, graph.item_classes(items), graph.similar_items(graph.vocabulary(items), 0.9), 0.24)


@query("vocabulary_containment", "WITH v AS (SELECT DISTINCT term FROM (SELECT lower(unnest(string_split(text, ' '))) AS term FROM benchmark)) SELECT doc_id AS id, term FROM documents, v WHERE contains(lower(text), term)")
def vocabulary_containment(read):
    """The whole vocabulary, as substrings."""
    terms = read("benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return graph.contained(read("documents").select(F.col("doc_id").alias("id"), "text"), terms)


@query(
    "scenario_sample",
    """WITH n AS (SELECT DISTINCT conv_id AS id, role AS theme FROM conversations), c AS (SELECT * FROM n, (VALUES ('novice'), ('expert')) p(persona), (VALUES ('plain'), ('formal')) s(style), (VALUES ('short'), ('long')) l(length))
    SELECT id, theme, persona, style, length FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', id::VARCHAR, theme, persona, style, length, 's'))) AS r FROM c) WHERE r <= 3""",
)
def scenario_sample(read):
    nodes = read("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_set("role").alias("themes"))
    return graph.scenarios(nodes, ["novice", "expert"], ["plain", "formal"], ["short", "long"], 3, "s")


@query(
    "edge_patterns",
    """WITH n AS (SELECT c_custkey AS id, c_mktsegment AS label FROM customer UNION ALL SELECT -1 - n_nationkey, n_name FROM nation)
    SELECT c_custkey AS source, (-1 - c_nationkey)::BIGINT AS target, 'lives in' AS type, a.label AS source_label, b.label AS target_label FROM customer JOIN n a ON a.id = c_custkey JOIN n b ON b.id = -1 - c_nationkey WHERE c_custkey % 3 <> 1""",
)
def edge_patterns(read):
    """Edges of two of three kinds with the labels of both ends."""
    customers = read("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("label"))
    nodes = customers.unionByName(read("nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("label")))
    kind = F.when(F.col("c_custkey") % 3 == 1, "born in").otherwise("lives in")
    edges = read("customer").select(F.col("c_custkey").cast("long").alias("source"), (-1 - F.col("c_nationkey")).cast("long").alias("target"), kind.alias("type"))
    return graph.edge_patterns(edges, nodes, ("lives in", "works in")).select("source", "target", "type", "source_label", "target_label")


@query("line_vocabulary", f"SELECT kind AS field, count(DISTINCT line) AS n_items FROM ({_LINES}) GROUP BY kind")
def line_vocabulary(read):
    v = graph.vocabulary(lines(read).select(F.col("doc_id").alias("id"), F.col("kind").alias("field"), F.sha2("line", 256).alias("item")))
    return v.groupBy("field").agg(F.count(F.lit(1)).alias("n_items"))

"""Queries over contents, evaluation and the smaller relational operators.  JSON, XML and HTML are made of the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import content as C
from loomwork.operators import lexical as L
from loomwork.operators import ranking as R
from loomwork.operators import service as S
from loomwork.plans.registry import query
from loomwork.plans.retrieval import _APPROX, _COS, _approximate, _run, _topk
from loomwork.plans.service import _QRELS, passage_qrels
from loomwork.plans.text import _LINES, TOKENS_B, lines

#: Zones of four lines, five zones a page; the last line of a zone that ends without a full stop is its fragment.
_ZONE = f"SELECT doc_id, (seq // 20)::INT AS p, ((seq % 20) // 4)::INT AS z, seq, line, NOT ends_with(line, '.') AND seq = max(seq) OVER (PARTITION BY doc_id, seq // 4) AS part FROM ({_LINES})"


def _result_json(read):
    last = F.struct("seq", "line")
    zone = lines(read).groupBy("doc_id", F.floor(F.col("seq") / 20).alias("p"), F.floor(F.col("seq") % 20 / 4).alias("z")).agg(F.sort_array(F.collect_list(last)).alias("x"))
    texts = F.transform("x", lambda x: x["line"])
    open_end = ~F.element_at(texts, -1).endswith(".")
    zone = zone.select("doc_id", "p", F.struct("z", F.when(open_end, F.slice(texts, 1, F.size(texts) - 1)).otherwise(texts).alias("paragraphs"), F.when(open_end, F.element_at(texts, -1)).alias("last_text_fragment")).alias("zone"))
    page = zone.groupBy("doc_id", "p").agg(F.sort_array(F.collect_list("zone")).alias("zones"))
    pages = page.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("p").alias("page_number"), "zones"))).alias("pages"))
    return pages.select("doc_id", F.to_json(F.struct("pages")).alias("json"))


@query(
    "postprocess_nodes",
    f"""WITH i AS (SELECT *, NOT part AND starts_with(upper(line), 'BOX') AND regexp_matches(upper(line), '^BOX \\w?-?\\d+') AND contains(line, '|') AS box FROM ({_ZONE})),
    g AS (SELECT *, coalesce(sum((NOT part AND NOT box)::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM i),
    t AS (SELECT doc_id, string_agg(line, ' ' ORDER BY seq) AS text, max(seq) FILTER (NOT part) AS at_ FROM g GROUP BY doc_id, grp, CASE WHEN box THEN seq END)
    SELECT doc_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY at_) FILTER (at_ IS NOT NULL), '')) AS digest FROM t GROUP BY doc_id""",
)
def postprocess_nodes(read):
    return C.joined_results(_result_json(read), "doc_id", "json").select("doc_id", F.md5("text").alias("digest"))


@query(
    "chapter_nodes",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, '## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '') AS t FROM conversations WHERE turn % 4 <> 2),
    d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c),
    walk AS (SELECT conv_id, k, turn AS head, length(t) AS n FROM d WHERE k = 1
        UNION ALL SELECT d.conv_id, d.k, CASE WHEN n < 300 THEN head ELSE turn END, CASE WHEN n < 300 THEN n + 2 + length(t) ELSE length(t) END FROM walk JOIN d ON d.conv_id = walk.conv_id AND d.k = walk.k + 1)
    SELECT conv_id, (dense_rank() OVER (PARTITION BY conv_id ORDER BY head))::BIGINT AS node, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest FROM d JOIN walk USING (conv_id, k) GROUP BY conv_id, head""",
)
def chapter_nodes(read):
    """Turns as chapters, every fourth a table; one more document is no JSON."""
    from pyspark.sql import Window

    chapter = F.struct(
        "turn", F.when(F.col("turn") % 4 == 2, "TABLE").otherwise("DEFAULT").alias("type"), F.struct(F.coalesce("role", F.lit("")).alias("extracted_text")).alias("header"), F.array(F.struct(F.coalesce("text", F.lit("")).alias("extracted_text"))).alias("elements")
    )
    documents = read("conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(chapter)).alias("chapters"))).alias("json"))
    broken = documents.limit(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit("{no json").alias("json"))
    nodes = C.chapter_nodes(documents.unionByName(broken), "conv_id", "json", 300)
    return nodes.select(F.col("doc").alias("conv_id"), F.row_number().over(Window.partitionBy("doc").orderBy("seq")).cast("long").alias("node"), F.md5("text").alias("digest"))


def _tei(read):
    e = lambda c: F.xpath_string(F.lit("<a/>"), F.lit("a")) if c is None else F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    ref = F.concat(
        F.lit("<biblStruct><analytic><title>"), e(F.col("p_name")), F.lit("</title><author><persName><forename>"), e(F.col("p_brand")), F.lit("</forename> <surname>"), e(F.col("p_type")), F.lit("</surname></persName></author>"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<idno type="DOI">10.1/'), F.col("p_partkey"), F.lit("</idno>"))).otherwise(F.lit('<idno type="ISBN">1</idno>')),
        F.lit('</analytic><imprint><publisher>P</publisher><date type="published">2001</date></imprint>'), F.when(F.col("p_partkey") % 3 == 0, F.lit('<note type="raw_reference">raw</note>')).otherwise(F.lit("")), F.lit("</biblStruct>"),
    )
    body = "<text><front><abstract><p>A</p></abstract></front><body><div><p>x</p></div><div><p>y</p></div><figure type='table'><p>t</p></figure></body><back>"
    return read("part").select("p_partkey", F.concat(F.lit(f"<TEI xmlns='http://www.tei-c.org/ns/1.0'>{body}"), ref, F.lit("</back></text></TEI>")).alias("xml"))


@query(
    "tei_references",
    "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, 'P' AS publisher, '2001' AS published_date, trim(p_brand) || '  ' || trim(p_type) AS author, (p_partkey % 3 = 0)::INT AS n_raw FROM part",
)
def tei_references(read):
    got = C.tei_references(_tei(read), "p_partkey", "xml")
    r = F.col("refs")[0]
    return got.select("p_partkey", r["title"].alias("title"), r["doi"].alias("doi"), r["publisher"].alias("publisher"), r["published_date"].alias("published_date"), r["authors"][0].alias("author"), F.size("raw_refs").alias("n_raw"))


@query("tei_content", "SELECT p_partkey, unnest(['abstract', 'div', 'div', 'table']) AS type, unnest([0, 1, 2, 3])::INT AS seq FROM part")
def tei_content(read):
    got = C.tei_references(_tei(read), "p_partkey", "xml")
    return got.select("p_partkey", F.posexplode("content").alias("seq", "c")).select("p_partkey", "c.type", "seq")


def _cards(read):
    row = lambda label, value: F.concat(F.lit(f"<dt>{label}</dt>\n<dd><span>"), value, F.lit("</span></dd>"))
    html = F.concat(F.lit("<dl>"), row("Nation", F.col("c_nationkey").cast("string")), row("Segment", F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, row("Note", F.col("c_name"))).otherwise(F.lit("")), F.lit("</dl>"))
    return read("customer").select("c_custkey", "c_mktsegment", html.alias("html"))


@query("definition_lists", "SELECT c_custkey, c_nationkey::VARCHAR AS nation, trim(c_mktsegment) AS segment, CASE WHEN c_custkey % 3 = 0 THEN trim(c_name) END AS note FROM customer")
def definition_lists(read):
    return _cards(read).select("c_custkey", *[C.definition("html", label).alias(label.lower()) for label in ("Nation", "Segment", "Note")])


@query("class_fields", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Region not found' END AS region FROM customer")
def class_fields(read):
    html = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit('<div class="x field--region y"> ')).otherwise(F.lit('<div class="field--regional">')), F.col("c_mktsegment"), F.lit("</div>"))
    return read("customer").select("c_custkey", C.class_text(html, "div", "field--region", "Region not found").alias("region"))


@query(
    "link_resolver",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'https://x.example/10.1/' || c_custkey || '.pdf' WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'https://w/10.1%2F' || c_custkey END AS pdf_download_link,
    CASE WHEN c_custkey % 3 = 1 AND c_custkey % 7 <> 0 THEN 'https://c/10.1/' || c_custkey END AS crossref_metadata_url FROM customer""".replace("c_custkey % 3 = 1 AND c_custkey % 5 = 0", "c_custkey % 3 = 1 AND c_custkey % 5 = 0 AND c_custkey % 7 <> 0"),
)
def link_resolver(read):
    k = F.col("c_custkey")
    button = F.when(k % 3 == 0, "Download").when(k % 3 == 1, "View").otherwise("Buy")
    link = F.concat(F.lit("https://x.example/10.1/"), k, F.when((k % 3 == 0) & (k % 2 == 0), F.lit(".pdf")).otherwise(F.lit("/")))
    publishers = read("customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("10.1/"), k).alias("doi"), F.when(k % 5 == 0, "Wiley").otherwise("Other").alias("publisher"))
    return C.resolved_links(read("customer").select("c_custkey", link.alias("link"), button.alias("button")), publishers, "https://c", "https://w").select("c_custkey", "pdf_download_link", "crossref_metadata_url")


@query("page_markdown", "SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || '**' || c_mktsegment || '** at [home](http://x)' || chr(10) || chr(10) || '- one' || chr(10) || '- two' AS markdown, c_name || ' ' || c_mktsegment || ' at home one two' AS text FROM customer")
def page_markdown(read):
    html = F.concat(F.lit("<style>p{}</style><h1>"), F.col("c_name"), F.lit("</h1>\n<p><b>"), F.col("c_mktsegment"), F.lit('</b> at <a href="http://x">home</a></p><ul><li>one</li><li>two</li></ul>'))
    return read("customer").select("c_custkey", C.markdown(html).alias("markdown"), C.page_text(html).alias("text"))


_QA = "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '<1-hop>' || chr(10) || text || ' <2-hop>' || chr(10) || 'second ' || item_id ELSE text END AS context FROM benchmark"


def _records(read):
    context = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<1-hop>\n"), "text", F.lit(" <2-hop>\nsecond "), "item_id")).otherwise(F.col("text"))
    record = F.struct(F.concat(F.lit("question "), "item_id").alias("user_input"), F.array(context).alias("reference_contexts"), F.array(F.concat(F.lit("c"), "item_id")).alias("reference_context_ids"))
    return read("benchmark").select("item_id", F.to_json(record).alias("json"))


@query("qa_corpus", "SELECT 'c' || item_id || '__1hop' AS did, trim(text) AS text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'c' || item_id || '__2hop', 'second ' || item_id FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'c' || item_id, trim(text) FROM benchmark WHERE item_id % 2 = 1")
def qa_corpus(read):
    return C.qa_dataset(_records(read), "json", F.col("item_id"))[1]


@query("qa_relevant", "SELECT item_id AS qid, 'c' || item_id AS cid, 'question ' || item_id AS text FROM benchmark")
def qa_relevant(read):
    queries, _, judgements = C.qa_dataset(_records(read), "json", F.col("item_id"))
    return judgements.join(queries, "qid")


@query("retrieval_sets_merge", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ds2_' ELSE '' END || o_orderkey AS qid, CASE WHEN o_custkey % 3 = 0 THEN 'ds2_' ELSE '' END || o_custkey AS did FROM orders UNION ALL SELECT DISTINCT o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0")
def retrieval_sets_merge(read):
    """Judgements of two sets; the first has every second query and every third document of the other."""
    o = read("orders").select(F.col("o_orderkey").cast("string").alias("qid"), F.col("o_custkey").cast("string").alias("did"))
    q, c = o.select("qid", F.lit("q").alias("text")).distinct(), o.select("did", F.lit("d").alias("text")).distinct()
    even, third = F.col("qid").cast("long") % 2 == 0, F.col("did").cast("long") % 3 == 0
    one = q.where(even), c.where(third).unionByName(c.where(third).limit(0)), o.where(even & third).distinct()
    # the ids that clash are those of the first set's tables
    return S.merged_retrieval_sets(one, (q, c, o))[2]


@query("scoped_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def scoped_rows(read):
    return S.scoped(read("orders"), o_orderstatus="O", o_orderpriority="1-URGENT").select("o_orderkey")


@query("first_with_content", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 50 ORDER BY doc_id LIMIT 100")
def first_with_content(read):
    """The first hundred documents with fifty characters or more: a report of the first rows."""
    return S.with_content(read("documents"), "text", 50, 100, F.col("doc_id")).select("doc_id")


@query("parent_children", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def parent_children(read):
    joined = S.with_children(read("customer").select("c_custkey"), read("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.col("o_orderkey"), "children")
    return joined.select("c_custkey", F.size("children").cast("long").alias("n"), F.array_join("children", ",").alias("children"))


@query("enriched_items", "SELECT o_custkey, string_agg(CASE WHEN o_orderkey % 4 = 0 THEN 'own' ELSE coalesce(CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'full' END, '-') END, ',' ORDER BY o_orderkey) AS filled FROM orders GROUP BY o_custkey")
def enriched_items(read):
    item = F.struct("o_orderkey", F.col("o_orderstatus").alias("configuration_id"), F.when(F.col("o_orderkey") % 4 == 0, "own").alias("configuration"))
    rows = read("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("settings", F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("full")))
    filled = F.transform("items", lambda x: F.coalesce(x["configuration"], F.lit("-")))
    return S.enriched(rows, "items", "settings").select("o_custkey", F.array_join(filled, ",").alias("filled"))


@query("agent_references", "SELECT page_id, coalesce(url, 'Unknown') AS title, coalesce(url, '') AS url, 'body ' || page_id AS text FROM pages")
def agent_references(read):
    sources = F.concat(F.lit("{'link': '"), "url", F.lit("', 'k': 1};{'link': 'http://second'}"))
    got = S.agent_reference(sources, F.col("url"), F.to_json(F.struct(F.concat(F.lit("body "), "page_id").alias("text"))))
    return read("pages").select("page_id", got.alias("r")).select("page_id", "r.*")


@query("page_extents", "SELECT doc_id, seq // 20 AS page, min(seq % 20) * 50 AS top, max(seq % 20) * 50 + 40 AS bottom, ((min(seq % 20) * 50 + max(seq % 20) * 50 + 40) // 2) AS middle FROM (" + _LINES + ") GROUP BY ALL")
def page_extents(read):
    """Least top, greatest bottom and whole middle of each page's boxes."""
    place = (F.col("seq") % 20) * 50
    e = lines(read).groupBy("doc_id", F.floor(F.col("seq") / 20).alias("page")).agg(F.min(place).alias("top"), F.max(place + 40).alias("bottom"))
    return e.withColumn("middle", F.floor((F.col("top") + F.col("bottom")) / 2))


@query("property_counts", "SELECT count(*) AS nodes, count(*) FILTER (text IS NOT NULL AND text <> '') AS with_text, count(*) FILTER (source = 'src0') AS of_first_source FROM documents")
def property_counts(read):
    return read("documents").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"), F.count_if(F.col("source") == "src0").alias("of_first_source"))


@query("run_profile", "SELECT event_type, count(*)::BIGINT AS queries, round(sum(value), 6) AS seconds, round(CASE WHEN sum(value) = 0 THEN 0 ELSE count(*) / sum(value) END, 6) AS qps FROM events GROUP BY event_type")
def run_profile(read):
    return R.profile(read("events").withColumn("one", F.lit(1)), "event_type", "one", "value")


@query("vector_split", "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5(vec_id || '1'), vec_id) <= 100 THEN 'test' ELSE 'train' END AS part FROM embeddings")
def vector_split(read):
    return S.split_by_count(read("embeddings").select("vec_id"), "vec_id", 100)


@query("distinct_algorithms", "SELECT DISTINCT event_type AS algorithm, value > 50 AS batch FROM events")
def distinct_algorithms(read):
    return read("events").select(F.col("event_type").alias("algorithm"), (F.col("value") > 50).alias("batch")).distinct()


@query("parsed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS day FROM orders")
def parsed_dates(read):
    """Dates as day, short month and year; other texts are null."""
    written = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(F.lit("soon"))
    return read("orders").select("o_orderkey", F.try_to_timestamp(written, F.lit("d MMM yyyy")).cast("date").alias("day"))


@query("split_pages", "SELECT conv_id, unnest(string_split(t, chr(10) || '---' || chr(10))) AS page, (generate_subscripts(string_split(t, chr(10) || '---' || chr(10)), 1) - 1)::INT AS seq FROM (SELECT conv_id, string_agg(coalesce(role, ''), chr(10) || '---' || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def split_pages(read):
    whole = read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("r")))), lambda x: x["r"]), "\n---\n").alias("t"))
    return whole.select("conv_id", F.posexplode(F.split("t", "\n---\n")).alias("seq", "page"))


@query("ann_padded", f"WITH {_topk(_COS, 5)} SELECT qid, list(did ORDER BY rank) || [-1, -1]::BIGINT[] AS neighbors, len(list(did)) + 2 AS n FROM run GROUP BY qid")
def ann_padded(read):
    got = R.padded(_run(read, 5), 7)
    return got.select("qid", "neighbors", F.size("distances").cast("long").alias("n"))


@query(
    "ann_all_metrics",
    f"""{_APPROX}, l AS (SELECT qid, distance AS lim FROM truth WHERE rank = 10), hh AS (SELECT 'approximate' AS run, qid, rank, distance FROM run UNION ALL SELECT 'exact', qid, rank, distance FROM truth),
    j AS (SELECT hh.*, lim, t.distance AS true_ FROM hh JOIN l USING (qid) LEFT JOIN truth t USING (qid, rank)),
    s AS (SELECT CASE event_id % 2 WHEN 0 THEN 'approximate' ELSE 'exact' END AS run, value AS seconds FROM events)
    SELECT run, round(count(*) FILTER (distance <= lim + 1e-3) / 10 / (SELECT count(*) FROM l), 6) AS recall, round(count(*) FILTER (distance <= lim * 1.01) / 10 / (SELECT count(*) FROM l), 6) AS epsilon_01,
        round(count(*) FILTER (distance <= lim * 1.1) / 10 / (SELECT count(*) FROM l), 6) AS epsilon_10, round(sum(distance) / sum(true_), 6) AS rel, any_value(qps) AS qps, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99
    FROM j JOIN (SELECT run, round(1 / avg(seconds), 6) AS qps, round(quantile_cont(seconds, 0.5) * 1000, 6) AS p50, round(quantile_cont(seconds, 0.95) * 1000, 6) AS p95, round(quantile_cont(seconds, 0.99) * 1000, 6) AS p99 FROM s GROUP BY run) USING (run) GROUP BY run""",
)
def ann_all_metrics(read):
    truth = _run(read, 10)
    hits = _approximate(read).withColumn("run", F.lit("approximate")).select("run", "qid", "rank", "distance").unionByName(truth.withColumn("run", F.lit("exact")).select("run", "qid", "rank", "distance"))
    times = read("events").select(F.when(F.col("event_id") % 2 == 0, "approximate").otherwise("exact").alias("run"), F.col("value").alias("seconds"))
    return R.all_metrics(truth, hits, times, 10)


_BM25B = f"""WITH d AS (SELECT doc_id AS did, {TOKENS_B} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d),
    p AS (SELECT did, len(t) AS length, unnest(t) AS term FROM d), c AS (SELECT did, length, term, count(*) AS tf FROM p GROUP BY ALL),
    i AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM c, s GROUP BY term, n), q AS (SELECT item_id AS qid, unnest({TOKENS_B}) AS term FROM benchmark),
    w AS (SELECT qid, term, count(*) * CASE WHEN any_value(raw) < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE any_value(raw) END AS weight FROM q JOIN i USING (term) GROUP BY ALL),
    x AS (SELECT qid, did, round(sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / m))), 6) AS score FROM c JOIN w USING (term), s GROUP BY qid, did),
    z AS (SELECT qid, did, 0.0 AS score FROM (SELECT item_id AS qid, did FROM benchmark, (SELECT did FROM d ORDER BY did LIMIT 20)) ANTI JOIN x USING (qid, did)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM z))"""


@query("bm25_legacy", f"{_BM25B} SELECT qid, did, score, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_legacy(read):
    """The second tokenizer with the usual constants of a library."""
    tokens = T.tokens_alnum("text")
    return L.bm25(read("benchmark"), read("documents"), "item_id", "doc_id", tokens, tokens, 10, k1=1.5)


@query(
    "evaluation_sequence",
    f"""{_BM25B}, rel AS (SELECT DISTINCT qid, did FROM ({_QRELS})), nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
    runs AS (SELECT 'sparse' AS method, qid, did, rank FROM r WHERE rank <= 10 UNION ALL SELECT 'reversed', qid, did, 11 - rank FROM r WHERE rank <= 10),
    j AS (SELECT method, qid, rank, rel.did IS NOT NULL AS hit FROM runs LEFT JOIN rel USING (qid, did)),
    m AS (SELECT method, qid, k, min(rank) FILTER (hit AND rank <= k) AS f, count(*) FILTER (hit AND rank <= k) AS h FROM j, (VALUES (1), (10)) t(k) GROUP BY ALL)
    SELECT method, round(avg(coalesce(1.0 / f, 0)) FILTER (k = 10), 6) AS mrr_at_10, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END) FILTER (k = 10), 6) AS recall_at_10, round(avg((h > 0)::INT) FILTER (k = 1), 6) AS hit_rate_at_1 FROM m LEFT JOIN nr USING (qid) GROUP BY method""",
)
def evaluation_sequence(read):
    """Two methods evaluated in one job: the lexical ranking and its reverse."""
    run = bm25_legacy(read).select("qid", "did", "rank")
    got = R.evaluated({"sparse": run, "reversed": run.withColumn("rank", 11 - F.col("rank"))}, passage_qrels(read).select("qid", "did"), (1, 3, 5, 10, 20))
    return got.select("method", "mrr_at_10", "recall_at_10", "hit_rate_at_1")


_THEMES = "SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS themes FROM orders GROUP BY o_custkey"


@query(
    "multi_hop_samples",
    f"""WITH n AS ({_THEMES}), e AS (SELECT id AS source, id + 3 AS target FROM n WHERE id + 3 IN (SELECT id FROM n)),
    b AS (SELECT source, target, list_sort(list_intersect(x.themes, y.themes)) AS both_, x.themes AS own FROM e JOIN n x ON x.id = source JOIN n y ON y.id = target)
    SELECT source, target, unnest(CASE WHEN len(both_) > 0 THEN both_[1:2] ELSE own[1:1] END) AS theme, '<1-hop>' || chr(10) || chr(10) || 'customer ' || source || '|<2-hop>' || chr(10) || chr(10) || 'customer ' || target AS contexts FROM b""",
)
def multi_hop_samples(read):
    nodes = read("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("themes"))
    other = nodes.select((F.col("id") - 3).alias("source"), F.col("id").alias("target"))
    edges = nodes.select(F.col("id").alias("source")).join(other, "source")
    contexts = nodes.select("id", F.concat(F.lit("customer "), "id").alias("text"))
    return C.qa_samples(C.multi_hop_scenarios(edges, nodes, 2), contexts).select("source", "target", "theme", F.array_join("contexts", "|").alias("contexts"))


@query("file_sources", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'src ' || c_custkey END AS source FROM customer")
def file_sources(read):
    """Files named after customers; every second customer is a source, written otherwise."""
    files = read("customer").select("c_custkey", F.regexp_replace("c_name", "#", "_").alias("name"))
    sources = read("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit(" "), F.regexp_replace("c_name", "#", " - ")).alias("title"), F.concat(F.lit("src "), "c_custkey").alias("source"))
    return S.matched_files(files, sources, "name", F.col("title"), "source").select("c_custkey", "source")


@query("first_feedback", "SELECT c_custkey, c_nationkey, k AS o_orderkey, o_orderstatus, n_name FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1")
def first_feedback(read):
    """Customers with their first order and, where it is active, their nation: two left joins, the first match each."""
    orders = read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    nations = read("nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = S.with_first(read("customer").select("c_custkey", "c_nationkey"), orders, ["c_custkey"], F.col("o_orderkey"))
    return S.with_first(joined, nations, ["c_nationkey"], F.col("n_name"))


@query("length_mismatches", "SELECT a.o_custkey AS id, a.n AS n_orders, coalesce(b.n, 0) AS n_open FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) b USING (o_custkey) WHERE a.n <> coalesce(b.n, 0)")
def length_mismatches(read):
    """Lists that should be equally long and are not."""
    both = read("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("a"), F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("b"))
    return both.where(F.size("a") != F.size("b")).select("id", F.size("a").cast("long").alias("n_orders"), F.size("b").cast("long").alias("n_open"))


@query("runnable_definitions", "SELECT p_partkey AS name FROM part WHERE p_partkey % 7 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07)")
def runnable_definitions(read):
    definitions = read("part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 7 == 0).alias("disabled"))
    items = read("lineitem").withColumnRenamed("l_partkey", "name")
    return S.runnable(definitions, items.where("l_discount > 0.09 and l_tax > 0.07"), items.where("l_quantity > 45")).select("name")


@query("seeded_sample", "SELECT event_id FROM events ORDER BY md5(event_id || 'seed'), event_id LIMIT 50")
def seeded_sample(read):
    """Fifty rows in a fixed order that looks random: a sample, by its nature."""
    return S.shuffled(read("events").select("event_id"), "event_id", 50, "seed")


@query("url_operations", r"SELECT page_id, 'https://b.example/x/' || page_id AS joined, split_part(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/', -1) AS tail, replace(url_encode(url || ' é'), '%20', '+') AS quoted FROM pages")
def url_operations(read):
    plain = F.regexp_replace("url", r"[?#].*$", "")
    path = F.concat(F.lit("/x/"), "page_id")
    return read("pages").select("page_id", T.joined_url("https://b.example/", path).alias("joined"), T.last_segments(plain, 1).alias("tail"), F.url_encode(F.concat("url", F.lit(" é"))).alias("quoted"))


@query("harvested_links", "SELECT c_custkey, 'http://x/' || c_custkey AS link FROM customer WHERE c_custkey % 2 = 0")
def harvested_links(read):
    html = F.concat(F.lit('<a href="http://no">n</a><a class="c" href="http://x/'), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit('"><span>d</span></a>')).otherwise(F.lit('">d</a>')))
    return read("customer").select("c_custkey", F.explode(C.harvested_links(html)).alias("link"))


@query(
    "string_similarities",
    """WITH p AS (SELECT a.p_partkey AS x, b.p_partkey AS y, a.p_name AS s, b.p_name AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT x, y, round(1 - levenshtein(s, t) / greatest(length(s), length(t)), 6) AS levenshtein, round(len(list_filter(range(1, least(length(s), length(t)) + 1), lambda i: s[i] = t[i])) / greatest(length(s), length(t)), 6) AS hamming FROM p""",
)
def string_similarities(read):
    """Names of neighbouring parts."""
    a = read("part").select(F.col("p_partkey").alias("x"), F.col("p_name").alias("s"))
    b = read("part").select((F.col("p_partkey") - 1).alias("x"), F.col("p_partkey").alias("y"), F.col("p_name").alias("t"))
    return a.join(b, "x").select("x", "y", F.round(T.levenshtein_ratio("s", "t"), 6).alias("levenshtein"), F.round(T.hamming_ratio("s", "t"), 6).alias("hamming"))

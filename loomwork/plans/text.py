"""Queries over texts: functions, tokenizers, lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import hybrid as H
from loomwork.operators import lexical as L
from loomwork.plans.registry import query

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_A = f"list_filter(regexp_extract_all(lower({{}}), '\\p{{L}}+'), lambda w: w NOT IN ({_STOP}))"
_B = f"list_transform(list_filter(regexp_split_to_array(trim({{}}), '\\s+'), lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{Nd}}\\p{{Nl}}]+') AND w NOT IN ({_STOP})), lambda w: lower(w))"


def _sql(template: str, expr: str) -> str:
    return template.replace("{}", expr).replace("{{", "{").replace("}}", "}")


TOKENS_A, TOKENS_B = _sql(_A, "text"), _sql(_B, "text")

for _name, _tokens, _oracle in (("tokenize_a", T.tokens_letters, TOKENS_A), ("tokenize_b", T.tokens_alnum, TOKENS_B)):
    query(_name, f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_oracle} AS t FROM documents)")(
        lambda read, f=_tokens: read("documents").select("doc_id", f("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))
    )


@query("bm25_stats", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_A}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def bm25_stats(read):
    return L.corpus_terms(L.term_counts(read("documents"), "doc_id", T.tokens_letters("text")))


_BM25 = f"""WITH d AS (SELECT doc_id AS did, {TOKENS_A} AS t FROM documents), l AS (SELECT did, len(t) AS length FROM d), s AS (SELECT count(*) AS n, avg(length) AS mean_length FROM l),
    c AS (SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(t) AS term FROM d) GROUP BY ALL),
    i AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM c, s GROUP BY term, n),
    w AS (SELECT qid, q.term, count(*) * any_value(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END) AS weight
        FROM (SELECT item_id AS qid, unnest({TOKENS_A}) AS term FROM benchmark) q JOIN i ON i.term = q.term GROUP BY qid, q.term),
    m AS (SELECT qid, c.did, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM c JOIN w ON w.term = c.term JOIN l ON l.did = c.did, s GROUP BY qid, c.did),
    f AS (SELECT item_id AS qid, did FROM benchmark, (SELECT did FROM d ORDER BY did LIMIT 20)),
    a AS (SELECT * FROM m UNION ALL SELECT qid, did, 0.0 FROM f ANTI JOIN m USING (qid, did)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM a)"""


def _bm25(read, k: int = 10):
    return L.bm25(read("benchmark"), read("documents"), "item_id", "doc_id", T.tokens_letters("text"), T.tokens_letters("text"), k)


@query("bm25_topk", f"{_BM25} SELECT qid, did, score, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_topk(read):
    return _bm25(read)


_DOC_TF = f"SELECT doc_id AS did, term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest({TOKENS_A}) AS term FROM documents) GROUP BY ALL"
_SPARSE = f"""t AS ({_DOC_TF}), n AS (SELECT did, sqrt(sum(weight * weight)) AS norm FROM t GROUP BY did),
    u AS (SELECT did, term, weight / norm AS weight FROM t JOIN n USING (did)), x AS (SELECT * FROM u WHERE did % 100 = 0)"""


@query(
    "sparse_dot",
    f"WITH {_SPARSE}, p AS (SELECT x.did AS qid, u.did, round(sum(x.weight * u.weight), 6) AS score FROM x JOIN u USING (term) WHERE x.did <> u.did GROUP BY ALL) "
    "SELECT qid, did, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM p) WHERE rank <= 10",
)
def sparse_dot(read):
    documents = read("documents").select(F.col("doc_id").alias("id"), "text").hint("rebalance")
    rows = documents.select("id", T.tokens_letters("text").alias("tokens"), F.lit(None).cast("array<float>").alias("embedding"))
    return H.search(rows.where("id % 100 = 0"), rows, 10, 0.0, 1.0)


def _searched(read):
    """Documents and vectors of one id."""
    documents = read("documents").select(F.col("doc_id").alias("id"), "text")
    both = documents.join(read("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "full")
    return both.select("id", T.tokens_letters("text").alias("tokens"), "embedding")


@query(
    "hybrid_full_topk",
    f"""WITH {_SPARSE}, p AS (SELECT x.did AS qid, u.did, sum(x.weight * u.weight) AS score FROM x JOIN u USING (term) WHERE x.did <> u.did GROUP BY ALL),
    g AS (SELECT a.vec_id AS qid, b.vec_id AS did, 1 - (round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    f AS (SELECT coalesce(g.qid, p.qid) AS qid, coalesce(g.did, p.did) AS did, round(0.7 * coalesce(g.score, 0) + 0.3 * coalesce(p.score, 0), 6) AS score FROM g FULL JOIN p ON g.qid = p.qid AND g.did = p.did)
    SELECT qid, did, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM f) WHERE rank <= 10""",
)
def hybrid_full_topk(read):
    """Documents and vectors of one id fused: 0.7 of the dense similarity of every vector to each query and 0.3 of the sparse."""
    rows = _searched(read)
    return H.search(rows.where("id % 100 = 0"), rows, 10)


_RERANK = f"""{_BM25}, qt AS (SELECT item_id AS qid, list_distinct({TOKENS_A}) AS q FROM benchmark),
    z AS (SELECT r.qid, r.did, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM r JOIN qt USING (qid) JOIN d USING (did) WHERE rank <= 100)
    SELECT qid, did, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM z) WHERE rank <= 10"""


@query("rerank", _RERANK.replace("LIMIT 20)", "LIMIT 200)"))
def rerank(read):
    candidates = _bm25(read, 100)
    queries = read("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = read("documents").select(F.col("doc_id").alias("did"), "text")
    return L.reranked(candidates, queries, docs, lambda q, t: L.overlap_score(T.tokens_letters(q), T.tokens_letters(t)), 10)


@query("dehyphenate", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(\w{6})(\w{3})', '\1- \2', 'g'), '(\w+)- (\w+)', '\1\2', 'g')) AS digest FROM documents".replace(r"\w", r"[\p{L}\p{M}\p{N}_]"))
def dehyphenate(read):
    """Words of the texts are hyphenated by expression first, as none are."""
    split = F.regexp_replace("text", r"([\p{L}\p{M}\p{N}_]{6})([\p{L}\p{M}\p{N}_]{3})", "$1- $2")
    return read("documents").select("doc_id", F.md5(T.dehyphenated(split)).alias("digest"))


_LINES = "SELECT doc_id, seq::INT AS seq, line, CASE WHEN seq % 7 = 0 THEN 'Section header' WHEN seq % 11 = 3 THEN 'List item' WHEN seq % 13 = 5 THEN 'Page footer' WHEN seq % 17 = 6 THEN 'Caption' ELSE 'Text' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"


def lines(read):
    """Layout elements derived from the lines of the documents, with kinds by their number."""
    seq = F.col("seq")
    kind = F.when(seq % 7 == 0, "Section header").when(seq % 11 == 3, "List item").when(seq % 13 == 5, "Page footer").when(seq % 17 == 6, "Caption").otherwise("Text")
    return read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("kind", kind)


#: What layout elements may begin with, by number: enough for every rule to apply.
_PREFIXES = ("Source: ", "Notes and sources: ", "Figure 3 | ", "Table A-2 ", "Box 1 | ", "BOX b-2 ", "note: ", "Sources: ", "Suggested Citation: ", "figure ")
_ELEMENTS = f"SELECT doc_id, seq, kind, coalesce(list_value({', '.join(repr(p) for p in _PREFIXES)})[(seq % 31) // 2 + 1], '') || line AS line FROM ({_LINES})"


def prefixed_lines(read):
    """Lines of which some begin as notes, captions, titles and boxes do."""
    prefix = F.try_element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.floor(F.col("seq") % 31 / 2) + 1).cast("int"))
    return lines(read).withColumn("line", F.concat(F.coalesce(prefix, F.lit("")), "line"))


_SHORT_SOURCE = "regexp_matches(upper(line), '^SOURCES?:') AND len(string_split(line, ' ')) < 10"
_JUNK = f"""(kind IN ('Picture', 'Table', 'Page header', 'Page footer') OR length(line) < 4 OR starts_with(line, 'Suggested Citation:') OR {_SHORT_SOURCE}
    OR regexp_matches(upper(line), '^(NOTE:|NOTES:|ABBREVIATIONS:|NOTES AND SOURCES:)') OR kind = 'Caption' AND regexp_matches(upper(line), '^(FIGURE|TABLE)')
    OR regexp_matches(upper(line), '^(FIGURE|TABLE) \\w?-?\\d+') AND contains(line, '|'))"""
_CHUNK = r"(len(string_split(line, ' ')) > 7 OR kind = 'List item' OR starts_with(upper(line), 'BOX') AND (kind = 'Section header' OR regexp_matches(upper(line), '^BOX \w?-?\d+') AND contains(line, '|')))"


@query("junk_filter", f"SELECT kind, count(*) FILTER ({_JUNK}) AS n_junk, count(*) FILTER (NOT {_JUNK}) AS n_kept FROM ({_ELEMENTS}) GROUP BY kind")
def junk_filter(read):
    junk = T.is_junk("line", "kind")
    return prefixed_lines(read).groupBy("kind").agg(F.count_if(junk).alias("n_junk"), F.count_if(~junk).alias("n_kept"))


@query("text_chunk_filter", f"SELECT doc_id, seq FROM ({_ELEMENTS}) WHERE {_CHUNK}")
def text_chunk_filter(read):
    return prefixed_lines(read).where(T.is_text_chunk("line", "kind")).select("doc_id", "seq")


_TERMS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM documents"


@query(
    "term_normalize",
    rf"SELECT term, CASE WHEN length(x) > 7 THEN regexp_replace(x, 's+$', '') ELSE x END AS normal FROM (SELECT term, trim(regexp_replace(regexp_replace(trim(lower(term)), '[^a-z0-9\s-]', '', 'g'), '\s+', ' ', 'g')) AS x FROM ({_TERMS}))",
)
def term_normalize(read):
    terms = read("documents").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return terms.select("term", T.normalized_term("term").alias("normal"))


@query("alnum_key", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}]', '', 'g') AS key, regexp_replace(url, '[\\/:*?\"<>|]', '_', 'g') AS safe, regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g') AS path FROM pages".replace('\\"', '"'))
def alnum_key(read):
    return read("pages").select("page_id", T.alnum_key("url").alias("key"), T.safe_name("url").alias("safe"), T.path_name("url").alias("path"))


for _size, _overlap in ((256, 40), (512, 20), (1024, 20)):
    _step = _size - _overlap
    query(
        f"chunk_overlap_{_size}",
        f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {_size}) / {_step}))::BIGINT + 1)) AS seq FROM w)
        SELECT doc_id, seq::INT AS seq, md5(array_to_string(w[seq * {_step} + 1 : seq * {_step} + {_size}], ' ')) AS digest FROM k WHERE len(w) > 0""",
    )(lambda read, s=_size, o=_overlap: read("documents").select("doc_id", F.explode(T.chunks("text", s, o)).alias("c")).select("doc_id", F.col("c.seq").alias("seq"), F.md5("c.text").alias("digest")))


@query(
    "hop_split",
    r"""SELECT conv_id, i::INT AS hop, part FROM (SELECT conv_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS i FROM (
    SELECT conv_id, list_filter(regexp_split_to_array(string_agg('<' || (turn + 1) || '-hop>' || chr(10) || chr(10) || text, '' ORDER BY turn), '<\d+-hop>\s*'), lambda x: x <> '') AS p FROM conversations GROUP BY conv_id))""",
)
def hop_split(read):
    turns = read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    marked = turns.select("conv_id", F.array_join(T.with_hop_marks(F.transform("t", lambda x: x["text"])), "").alias("x"))
    return marked.select("conv_id", F.posexplode(T.hop_parts("x")).alias("hop", "part"))


@query("question_clean", r"SELECT conv_id, turn, trim(regexp_replace(trim((turn + 1) || '. ' || text), '^\d+[\).\s]', '')) AS question FROM conversations")
def question_clean(read):
    return read("conversations").select("conv_id", "turn", T.clean_question(F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "text")).alias("question"))


@query("split_tags", "SELECT page_id, list_filter(list_transform(string_split(replace(url, '/', ' ; '), ';'), lambda x: trim(x)), lambda x: x <> '') AS tags FROM pages")
def split_tags(read):
    return read("pages").select("page_id", T.split_list(F.replace("url", F.lit("/"), F.lit(" ; "))).alias("tags"))


@query("section_offsets", f"SELECT doc_id, seq, (coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM ({_LINES})")
def section_offsets(read):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return lines(read).select("doc_id", "seq", F.coalesce(F.sum(F.length("line")).over(order), F.lit(0)).cast("long").alias("start"))


@query(
    "paragraph_join",
    f"""WITH l AS (SELECT doc_id, seq, line, ends_with(line, '.') AS done FROM ({_LINES})), g AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM l),
    p AS (SELECT doc_id, grp, string_agg(line, ' ' ORDER BY seq) AS text, bool_or(done) AS whole FROM g GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (whole) AS n_paragraphs, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY grp) FILTER (whole), '')) AS digest FROM p GROUP BY doc_id""",
)
def paragraph_join(read):
    from loomwork.operators.folds import joined_paragraphs

    joined = joined_paragraphs(lines(read), "doc_id", "seq", "line", T.is_sentence_end("line"))
    return joined.groupBy("doc_id").agg(
        F.count_if("whole").alias("n_paragraphs"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("whole"), F.struct("number", "text")))), lambda x: x["text"]), "\n\n")).alias("digest"),
    )

"""Queries of the service: references, threads, feedback, paging, data sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import knn as K
from loomwork.operators import service as S
from loomwork.plans.registry import query


@query("dedup_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_first(read):
    return S.first_of_text(read("documents"), "text", "doc_id")


@query("group_by_source", "SELECT source, count(*) AS n, min(doc_id) AS first_doc, count(*) - count(DISTINCT text) AS n_repeated FROM documents GROUP BY source")
def group_by_source(read):
    d = read("documents").select("source", "doc_id", F.sha2("text", 256).alias("key"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), (F.count(F.lit(1)) - F.countDistinct("key")).alias("n_repeated"))


@query("thread_summary", "SELECT conv_id, count(turn) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def thread_summary(read):
    return read("conversations").groupBy("conv_id").agg(F.count("turn").alias("n_messages"), F.max("turn").alias("last_turn"))


@query("thread_last", "SELECT conv_id, arg_max(role, turn) AS role, left(arg_max(text, turn), 100) AS preview FROM conversations GROUP BY conv_id")
def thread_last(read):
    last = read("conversations").groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m"))
    return last.select("conv_id", F.col("m.role").alias("role"), F.substring("m.text", 1, 100).alias("preview"))


@query("thread_messages", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def thread_messages(read):
    return read("conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("position"))


@query("paged_list", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 10 OFFSET 10")
def paged_list(read):
    threads = read("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return S.page(threads, 10, 10, F.col("n").desc(), F.col("conv_id"))


@query("earliest_link", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def earliest_link(read):
    return S.first_by(read("events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@query("relevant_update", "SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_relevant FROM documents")
def relevant_update(read):
    return S.flagged(read("documents").select("doc_id", "source"), read("labels").where("quality = 1"), "doc_id", "is_relevant")


@query("json_flag", "SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT > 50 AS high FROM events")
def json_flag(read):
    k = F.get_json_object("props", "$.k").cast("int")
    return read("events").select("event_id", k.alias("k"), (k > 50).alias("high"))


@query("json_flag_default", "SELECT event_id, coalesce((props->>'$.admin') = 'true', false) AS admin FROM events")
def json_flag_default(read):
    return read("events").select("event_id", S.json_flag("props", "$.admin").alias("admin"))


@query("like_filter", "SELECT page_id, url FROM pages WHERE url LIKE '%example.net%' AND url LIKE 'https://%'")
def like_filter(read):
    return read("pages").where(F.col("url").like("%example.net%") & F.col("url").like("https://%")).select("page_id", "url")


@query("in_list", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def in_list(read):
    return read("documents").select("doc_id", "lang").join(read("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("threshold_sets", "SELECT user_id, count(*) AS n FROM events WHERE value >= 3 GROUP BY user_id HAVING count(*) >= 20")
def threshold_sets(read):
    return read("events").where("value >= 3").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("already_run", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def already_run(read):
    return read("documents").select("doc_id").join(read("labels").select("doc_id"), "doc_id", "left_anti")


@query("mime_first", "SELECT page_id, CASE WHEN contains(url, '.html') THEN '.html' WHEN contains(url, '#top') THEN '#top' END AS mime FROM pages")
def mime_first(read):
    return read("pages").select("page_id", T.first_allowed("url", (".html", "#top")).alias("mime"))


@query(
    "domain_dispatch",
    "SELECT split_part(url, '/', 3) AS domain, CASE WHEN ends_with(split_part(url, '/', 3), '.net') THEN 'net' WHEN ends_with(split_part(url, '/', 3), '.org') THEN 'org' ELSE 'other' END AS handler, count(*) AS n FROM pages GROUP BY ALL",
)
def domain_dispatch(read):
    d = read("pages").select(T.url_domain("url").alias("domain"))
    handler = F.when(F.col("domain").endswith(".net"), "net").when(F.col("domain").endswith(".org"), "org").otherwise("other")
    return d.groupBy("domain", handler.alias("handler")).agg(F.count(F.lit(1)).alias("n"))


@query("url_parts", r"SELECT page_id, split_part(url, '/', 3) AS domain, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS tail FROM pages")
def url_parts(read):
    return read("pages").select("page_id", T.url_domain("url").alias("domain"), T.url_tail("url").alias("tail"))


@query("payload_projection", "SELECT doc_id, lang, n_chars FROM documents")
def payload_projection(read):
    return read("documents").select("doc_id", "lang", "n_chars")


@query("group_feedback", "SELECT conv_id, map_from_entries(list((role, fields) ORDER BY role))::VARCHAR IS NOT NULL AS has_map, count(*) AS n_configs, sum(len(fields))::BIGINT AS n_fields FROM (SELECT conv_id, role, list(turn ORDER BY turn) AS fields FROM conversations GROUP BY ALL) GROUP BY conv_id")
def group_feedback(read):
    fields = read("conversations").groupBy("conv_id", "role").agg(F.sort_array(F.collect_list("turn")).alias("fields"))
    grouped = fields.groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "fields")))).alias("m"))
    sizes = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return grouped.select("conv_id", F.col("m").isNotNull().alias("has_map"), F.size("m").cast("long").alias("n_configs"), sizes.alias("n_fields"))


@query("duplicate_ids", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(read):
    return read("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("integrity_report", "SELECT (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS orphans, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) AS matched")
def integrity_report(read):
    marked = S.flagged(read("labels").select("doc_id"), read("documents"), "doc_id", "known")
    return marked.agg(F.count_if(~F.col("known")).alias("orphans"), F.count_if("known").alias("matched"))


@query(
    "query_feedback",
    "SELECT d.doc_id, l.quality, coalesce(l.toxic, 0)::INT AS toxic, n.n_same FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, count(*) AS n_same FROM documents GROUP BY source) n USING (source)",
)
def query_feedback(read):
    same = read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_same"))
    joined = read("documents").select("doc_id", "source").join(read("labels"), "doc_id", "left").join(same, "source", "left")
    return joined.select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"), "n_same")


@query(
    "rag_context",
    """WITH e AS (SELECT a.vec_id AS qid, b.vec_id AS did, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, did) AS rank FROM e),
    r AS (SELECT qid, rank, did, coalesce(source, 'Unknown') AS title, coalesce(CASE WHEN lang <> 'en' THEN 'https://doi.org/' || lang END, 'Unknown') AS url, coalesce(CASE WHEN lang <> 'en' THEN lang END, 'Unknown') AS doi, coalesce(text, '') AS text
        FROM h LEFT JOIN documents ON did = doc_id WHERE rank <= 10)
    SELECT qid, rank::INT AS rank, did, title, url, doi FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY rank) AS k FROM r) WHERE k = 1""",
)
def rag_context(read):
    e = read("embeddings")
    documents = read("documents").select(
        F.col("doc_id").alias("did"), F.col("source").alias("title"), F.lit(None).cast("string").alias("url"), F.when(F.col("lang") != "en", F.col("lang")).alias("doi"), "text"
    )
    return S.assembled_context(K.knn(K.every_hundredth(e), e, 10), documents, 10).drop("text")


_QRELS = "SELECT b.item_id AS qid, d.doc_id AS did, 1 AS score FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def passage_qrels(read):
    """Passages that stand in documents: a stated, small query set against all rows.

    Candidates share the second to fourth word of the passage; only these are compared as texts.
    """
    items = read("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    # a passage may begin inside a word of the document, so the first whole word between spaces is looked up
    keyed = items.withColumn("key", F.concat_ws(" ", F.slice(F.split("passage", " "), 2, 3)))
    triples = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 2)), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(3))))
    keys = F.array_distinct(F.get(F.transform(F.array(F.split("text", " ")), triples), F.lit(0)))
    documents = read("documents").select(F.col("doc_id").alias("did"), "text")
    candidates = documents.select("did", F.explode(keys).alias("key")).join(keyed, "key").select("did", "qid", "passage")
    return candidates.join(documents, "did").where(F.contains("text", "passage")).select("qid", "did").distinct().withColumn("score", F.lit(1))


@query("beir_qrels", _QRELS)
def beir_qrels(read):
    return passage_qrels(read)


@query("beir_corpus", """SELECT doc_id::VARCHAR AS _id, '' AS title, md5(text) AS text FROM documents""")
def beir_corpus(read):
    return read("documents").select(F.col("doc_id").cast("string").alias("_id"), F.lit("").alias("title"), F.md5("text").alias("text"))


@query("train_pairs", f"SELECT qid, min(did) AS first_did, count(*) AS n_pairs FROM ({_QRELS}) GROUP BY qid")
def train_pairs(read):
    return passage_qrels(read).groupBy("qid").agg(F.min("did").alias("first_did"), F.count(F.lit(1)).alias("n_pairs"))


@query("dataset_merge", "SELECT CASE WHEN b.item_id IS NULL THEN d.doc_id::VARCHAR ELSE 'ds2_' || d.doc_id END AS id, 'documents' AS origin FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id UNION ALL SELECT item_id::VARCHAR, 'benchmark' FROM benchmark")
def dataset_merge(read):
    one = read("benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("benchmark").alias("origin"))
    two = read("documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("origin"))
    return S.merged_datasets(one, two, "id")


@query("dataset_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || 's1'), doc_id) <= floor((SELECT count(*) FROM documents) * 0.8) THEN 'train' ELSE 'val' END AS part FROM documents")
def dataset_split(read):
    return S.split_by_hash(read("documents").select("doc_id"), "doc_id", 0.8, "s1")


@query("ragas_convert", f"SELECT qid::VARCHAR || '__' || (row_number() OVER (PARTITION BY qid ORDER BY did) - 1) || 'hop' AS cid, qid, did FROM ({_QRELS})")
def ragas_convert(read):
    place = F.row_number().over(Window.partitionBy("qid").orderBy("did")) - 1
    return passage_qrels(read).select(F.concat(F.col("qid").cast("string"), F.lit("__"), place.cast("string"), F.lit("hop")).alias("cid"), "qid", "did")


@query("rating_sets", "SELECT user_id, list(event_type ORDER BY ts, event_id) AS items, max(event_id) + 1 AS dimension FROM events GROUP BY user_id")
def rating_sets(read):
    g = read("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"), (F.max("event_id") + 1).alias("dimension"))
    return g.select("user_id", F.transform("x", lambda e: e["event_type"]).alias("items"), "dimension")


@query("union_by_name", "SELECT doc_id AS id, lang, NULL::BIGINT AS turn FROM documents UNION ALL SELECT conv_id, NULL, turn FROM conversations")
def union_by_name(read):
    return read("documents").select(F.col("doc_id").alias("id"), "lang").unionByName(read("conversations").select(F.col("conv_id").alias("id"), "turn"), allowMissingColumns=True)

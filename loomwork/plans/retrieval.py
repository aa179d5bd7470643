"""Queries over vectors and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.operators import knn as K
from loomwork.operators import ranking as R
from loomwork.plans.registry import query

_V = "embedding::DOUBLE[]"
_Q = f"q AS (SELECT vec_id AS qid, label AS qlabel, {_V} AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS did, label AS dlabel, {_V} AS e FROM embeddings)"
_COS = "round(1 - coalesce(list_cosine_similarity(qe, e), 0), 6) + 0.0"
_EUC = "round(list_distance(qe, e), 6)"
_HAM = "round(list_sum([CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1.0 ELSE 0.0 END for x in list_zip(qe, e)]) / len(e), 6)"


def _topk(distance: str, k: int, name: str = "run") -> str:
    return f"""{_Q}, {name}_all AS (SELECT qid, did, qlabel, dlabel, {distance} AS distance FROM q, c WHERE qid <> did),
        {name} AS (SELECT * FROM (SELECT qid, did, qlabel, dlabel, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, did) AS rank FROM {name}_all) WHERE rank <= {k})"""


def _run(read, k: int, metric: str = "angular"):
    e = read("embeddings")
    return K.knn(K.every_hundredth(e), e, k, metric)


def _qrels(read):
    """Relevant to a query vector: the others of its label."""
    e = read("embeddings").select("vec_id", "label")
    q = K.every_hundredth(e).select(F.col("vec_id").alias("qid"), "label")
    return q.join(e.select(F.col("vec_id").alias("did"), "label"), "label").where("qid <> did").select("qid", "did")


for _metric, _sql in (("angular", _COS), ("euclidean", _EUC), ("hamming", _HAM)):
    _name = {"angular": "knn_topk", "euclidean": "knn_euclidean", "hamming": "hamming_sign"}[_metric]
    query(_name, f"WITH {_topk(_sql, 10)} SELECT qid, did, distance, rank::INT AS rank FROM run")(lambda read, m=_metric: _run(read, 10, m))


@query("l2_normalize", f"SELECT vec_id, round(sqrt(list_sum([x * x for x in {_V}])), 6) AS length, round(list_sum([x for x in {_V}]) / sqrt(list_sum([x * x for x in {_V}])), 6) AS total FROM embeddings")
def l2_normalize(read):
    v = V.doubles("embedding")
    n = read("embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(V.norm(F.col("v")), 6).alias("length"), V.normalized(F.col("v")).alias("u"))
    return n.select("vec_id", "length", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    "cosine_links",
    f"WITH c AS (SELECT vec_id, {_V} AS e FROM embeddings) SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(a.e, b.e), 4) AS score FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3",
)
def cosine_links(read):
    """Links between any two vectors with cosine 0.3 or more, each once."""
    return K.linked_pairs(read("embeddings"), 0.3).select("source", "target", F.round("similarity", 4).alias("score"))


@query(
    "set_jaccard",
    """WITH s AS (SELECT conv_id, list_distinct(list(role ORDER BY turn)) AS a, list_distinct(list(substr(role, 1, 1) || (turn % 3) ORDER BY turn)) AS b, list_distinct(list(substr(role, 1, 1) || (turn % 2) ORDER BY turn)) AS c FROM conversations GROUP BY conv_id)
    SELECT conv_id, round(len(list_intersect(b, c)) / len(list_distinct(b || c)), 6) AS similarity, round(1 - len(list_intersect(b, c)) / len(list_distinct(b || c)), 6) < 1 - 1e-5 AS valid FROM s""",
)
def set_jaccard(read):
    key = lambda m: F.concat(F.substring("role", 1, 1), (F.col("turn") % m).cast("string"))
    s = read("conversations").groupBy("conv_id").agg(F.collect_set(key(3)).alias("b"), F.collect_set(key(2)).alias("c"))
    similarity = F.round(V.jaccard(F.col("b"), F.col("c")), 6)
    return s.select("conv_id", similarity.alias("similarity"), V.valid_distance("jaccard", 1 - similarity).alias("valid"))


_JUDGED = f"""WITH {_topk(_COS, 20)}, j AS (SELECT qid, did, rank, CASE WHEN qlabel = dlabel THEN 1 ELSE 0 END AS rel FROM run),
    n AS (SELECT qid, count(*) AS n_relevant FROM q JOIN c ON qlabel = dlabel AND qid <> did GROUP BY qid),
    p AS (SELECT j.qid, k, min(CASE WHEN rel = 1 AND rank <= k THEN rank END) AS first_rank, count(*) FILTER (rel = 1 AND rank <= k) AS n_hits,
        coalesce(sum(CASE WHEN rel = 1 AND rank <= k THEN 1 / log2(rank + 1) END), 0) AS dcg, coalesce(any_value(n_relevant), 0) AS n_relevant
        FROM j LEFT JOIN n USING (qid), (SELECT unnest([1, 3, 5, 10, 20])::INT AS k) GROUP BY j.qid, k),
    v AS (SELECT *, coalesce(list_sum([1 / log2(i + 1) for i in range(1, least(k, n_relevant) + 1)]), 0) AS ideal FROM p)"""
_VALUE = {
    "mrr": "coalesce(1.0 / first_rank, 0)",
    "ndcg": "CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END",
    "precision": "n_hits / k",
    "recall": "CASE WHEN n_relevant > 0 THEN n_hits / n_relevant ELSE 0 END",
    "hit_rate": "CASE WHEN n_hits > 0 THEN 1.0 ELSE 0.0 END",
}
for _m, _sql in _VALUE.items():
    query(f"ir_{_m}", f"{_JUDGED} SELECT '{_m}' AS metric, k, round(avg({_sql}), 6) AS value FROM v GROUP BY k")(
        lambda read, m=_m: R.metrics(_run(read, 20), _qrels(read)).where(F.col("metric") == m)
    )


@query("ir_wide", f"{_JUDGED} SELECT 'dense' AS method, " + ", ".join(f"round(avg({s}) FILTER (k = {k}), 6) AS {m}_at_{k}" for m, s in _VALUE.items() for k in R.KS) + " FROM v")
def ir_wide(read):
    return R.wide(R.metrics(_run(read, 20), _qrels(read)).withColumn("method", F.lit("dense")))


@query(
    "ir_map",
    f"""WITH {_topk(_COS, 20)}, j AS (SELECT qid, rank, CASE WHEN qlabel = dlabel THEN 1 ELSE 0 END AS rel FROM run),
    f AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS found FROM j), a AS (SELECT qid, avg(CASE WHEN rel = 1 THEN found / rank END) AS ap FROM f GROUP BY qid)
    SELECT round(avg(coalesce(ap, 0)), 6) AS map, count(*) AS n_queries FROM a""",
)
def ir_map(read):
    return R.mean_average_precision(_run(read, 20), _qrels(read))


# An approximate run to measure: the ten nearest by sign bits, with their true distances, in the order of these.
_APPROX = f"""WITH {_topk(_COS, 10, 'truth')}, h AS (SELECT qid, did, {_HAM} AS h, {_COS} AS distance FROM q, c WHERE qid <> did),
    cand AS (SELECT qid, did, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, did) AS r FROM h) WHERE r <= 10),
    run AS (SELECT qid, did, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, did) AS rank FROM cand)"""


def _approximate(read):
    e = read("embeddings")
    return K.rescored(_run(read, 10, "hamming"), e, e)


for _name, _limit, _eps in (("ann_recall", "distance + 1e-3", None), ("ann_epsilon_01", "distance * 1.01", 0.01), ("ann_epsilon_10", "distance * 1.1", 0.1)):
    query(
        _name,
        f"""{_APPROX}, l AS (SELECT qid, {_limit} AS lim FROM truth WHERE rank = 10)
        SELECT qid, round(count(*) FILTER (run.distance <= lim) / 10, 6) AS recall FROM l LEFT JOIN run USING (qid) GROUP BY qid""",
    )(lambda read, e=_eps: R.threshold_recall(_run(read, 10), _approximate(read), 10, e))


@query("ann_rel_error", f"{_APPROX} SELECT round(CASE WHEN sum(t.distance) < 0.01 THEN 'Infinity'::DOUBLE ELSE sum(run.distance) / sum(t.distance) END, 6) AS rel FROM truth t JOIN run USING (qid, rank)")
def ann_rel_error(read):
    return R.relative_error(_run(read, 10), _approximate(read))


@query(
    "ann_percentiles",
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, "
    + ", ".join(f"round(quantile_cont(value, {p}) * 1000, 4) AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))
    + " FROM events GROUP BY event_type",
)
def ann_percentiles(read):
    return R.percentiles(read("events"), "value", "event_type")


@query(
    "ann_best_of_runs",
    "SELECT event_type, round(min(mean), 6) AS best, round(1 / min(mean), 6) AS qps FROM (SELECT event_type, user_id % 5 AS run, avg(value) AS mean FROM events GROUP BY ALL) GROUP BY event_type",
)
def ann_best_of_runs(read):
    return R.best_of_runs(read("events").withColumn("run", F.col("user_id") % 5), "run", "event_type", "value")


@query(
    "ann_pareto",
    """WITH p AS (SELECT user_id, count(*) AS y, round(avg(value), 6) AS x FROM events GROUP BY user_id), b AS (SELECT y, max(x) AS x FROM p WHERE x <> 0 AND y <> 0 GROUP BY y)
    SELECT y, x FROM (SELECT *, max(x) OVER (ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) WHERE before IS NULL OR x > before""",
)
def ann_pareto(read):
    points = read("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("y"), F.round(F.avg("value"), 6).alias("x"))
    return R.pareto(points, "x", "y")


@query("ann_avg_distcomps", f"WITH {_Q} SELECT count(*) AS dist_comps, (SELECT count(*) FROM q) AS n_queries, round(count(*) / (SELECT count(*) FROM q), 6) AS per_query FROM q, c WHERE qid <> did")
def ann_avg_distcomps(read):
    e = read("embeddings").select("vec_id")
    n = e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 100 == 0).alias("n_queries"))
    total = F.col("n_queries") * (F.col("n") - 1)
    return n.select(total.alias("dist_comps"), "n_queries", F.round(R.ratio(total, F.col("n_queries")), 6).alias("per_query"))


@query("ann_validate_run", f"WITH {_topk(_COS, 10)} SELECT qid, count(*) - count(DISTINCT did) AS n_duplicates, count(*) > 10 AS too_many FROM run GROUP BY qid")
def ann_validate_run(read):
    return _run(read, 10).groupBy("qid").agg((F.count("did") - F.countDistinct("did")).alias("n_duplicates"), (F.count("did") > 10).alias("too_many"))


_GRID = {"metric": ["angular", "euclidean"], "lists": ["16", "64", "256"], "probes": ["1", "4", "16"]}


@query("param_grid", "SELECT * FROM " + ", ".join(f"(VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in v)}) t{i}({k})" for i, (k, v) in enumerate(_GRID.items())))
def param_grid(read):
    one = read("region").sparkSession.range(1).withColumnRenamed("id", "one")
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*[F.lit(x) for x in kv[1]]))), _GRID.items(), one).drop("one")


_SQ8 = f"""WITH {_Q}, b AS (SELECT min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT unnest(embedding) AS x FROM embeddings)),
    cq AS (SELECT did, e, [round((x - low) / (high - low) * 255)::INT for x in e] AS code FROM c, b),
    d AS (SELECT q.qid, cq.did, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(qc.code, cq.code)]) AS coarse, {_COS.replace(' e)', ' cq.e)')} AS distance
        FROM q JOIN cq qc ON qc.did = q.qid, cq WHERE q.qid <> cq.did),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coarse, did) AS r FROM d),
    g AS (SELECT qid, did, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, did) AS rank FROM f WHERE r <= 30)
    SELECT qid, did, distance, rank::INT AS rank FROM g WHERE rank <= 10"""


@query("sq8_rescore", _SQ8)
def sq8_rescore(read):
    """Scalar quantisation to bytes, thirty candidates by the codes, exact rank of these."""
    e = read("embeddings")
    coded = K.quantized_codes(e)
    coarse = K.knn(K.every_hundredth(coded), coded, 30, "squared", vector_column="code", digits=0)
    return K.rescored(coarse, e, e).where(F.col("rank") <= 10)


@query("ivf_topk")
def ivf_topk(read):
    e = read("embeddings")
    return K.ivf_search(K.every_hundredth(e), e, 10, lists=16, probes=10)


def _recall(read, found) -> object:
    """Share of the true ten nearest that an index returns, over all queries."""
    both = _run(read, 10).select("qid", "did").join(found.select("qid", "did", F.lit(1).alias("hit")).distinct(), ["qid", "did"], "left")
    return both.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n")).select((F.col("hits") >= 0.9 * F.col("n")).alias("reached"))


@query("ivf_recall", "SELECT true AS reached")
def ivf_recall(read):
    return _recall(read, ivf_topk(read))


@query("lsh_recall", "SELECT true AS reached")
def lsh_recall(read):
    return _recall(read, lsh_topk(read))


@query("knn_all", f"WITH c AS (SELECT vec_id, {_V} AS e FROM embeddings), d AS (SELECT a.vec_id AS qid, b.vec_id AS did, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM c a JOIN c b ON a.vec_id <> b.vec_id) SELECT qid, did, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, did) AS rank FROM d) WHERE rank <= 10")
def knn_all(read):
    """The ten nearest others of every vector."""
    e = read("embeddings")
    return K.knn(e, e, 10)


@query("lsh_topk")
def lsh_topk(read):
    e = read("embeddings")
    return K.lsh_search(K.every_hundredth(e), e, 10, planes=4, tables=24)

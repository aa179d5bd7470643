"""Metrics of rankings: of retrieval runs against relevance, of approximate against true neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run (qid, did, rank) with rel 0/1."""
    relevant = qrels.select("qid", "did", F.lit(1).alias("rel")).distinct()
    return run.join(relevant, ["qid", "did"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row per (qid, k) with what the metrics need; queries without hits of any kind have no entry in the run."""
    j = judged(run, qrels)
    n_relevant = qrels.groupBy("qid").agg(F.countDistinct("did").alias("n_relevant"))
    at = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hits = j.select("qid", "did", "rank", "rel", at)
    inside = (F.col("rel") == 1) & (F.col("rank") <= F.col("k"))
    found = hits.groupBy("qid", "k").agg(
        F.min(F.when(inside, F.col("rank"))).alias("first_rank"),
        F.count_if(inside).alias("n_hits"),
        F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.expr("aggregate(filter(sequence(1, k), i -> i <= n_relevant), 0.0D, (s, i) -> s + 1 / log2(i + 1.0D))")
    return found.join(n_relevant, "qid", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))).withColumn("ideal", ideal)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, k, value): MRR, NDCG, precision, recall and hit rate at each k, means over the run's queries."""
    q = per_query(run, qrels, ks)
    values = {
        "mrr": ratio(F.lit(1.0), F.col("first_rank")),
        "ndcg": ratio(F.col("dcg"), F.col("ideal")),
        "precision": ratio(F.col("n_hits"), F.col("k")),
        "recall": ratio(F.col("n_hits"), F.col("n_relevant")),
        "hit_rate": (F.col("n_hits") > 0).cast("double"),
    }
    long = q.select("k", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])).alias("x"))
    return long.groupBy("x.metric", "k").agg(F.round(F.coalesce(F.avg("x.value"), F.lit(0.0)), 6).alias("value"))


def mean_average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean over queries of the mean precision at the ranks of retrieved relevant documents."""
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = judged(run, qrels).withColumn("found", F.sum("rel").over(order))
    each = j.groupBy("qid").agg(F.avg(F.when(F.col("rel") == 1, F.col("found") / F.col("rank"))).alias("ap"))
    return each.agg(F.round(F.coalesce(F.avg(F.coalesce("ap", F.lit(0.0))), F.lit(0.0)), 6).alias("map"), F.count(F.lit(1)).alias("n_queries"))


def wide(long: DataFrame, label: str = "method") -> DataFrame:
    """One row per method, a column per metric@k."""
    names = [f"{m}_at_{k}" for m in ("mrr", "ndcg", "precision", "recall", "hit_rate") for k in KS]
    return long.withColumn("name", F.concat("metric", F.lit("_at_"), F.col("k").cast("string"))).groupBy(label).pivot("name", names).agg(F.first("value"))


def threshold_recall(truth: DataFrame, run: DataFrame, k: int, epsilon: float | None = None, slack: float = 1e-3) -> DataFrame:
    """Per query the share of the first k run distances within the k-th true distance, plus slack or times 1 + epsilon."""
    limit = truth.where(F.col("rank") == k).select("qid", (F.col("distance") + slack if epsilon is None else F.col("distance") * (1 + epsilon)).alias("limit"))
    hits = run.where(F.col("rank") <= k).select("qid", "distance")
    joined = limit.join(hits, "qid", "left")
    return joined.groupBy("qid").agg(F.round(F.count_if(F.col("distance") <= F.col("limit")) / k, 6).alias("recall"))


def relative_error(truth: DataFrame, run: DataFrame) -> DataFrame:
    """Sum of run distances by sum of true distances over ranks that both have; infinite where the latter is below 0.01."""
    both = truth.select("qid", "rank", F.col("distance").alias("true")).join(run.select("qid", "rank", "distance"), ["qid", "rank"])
    total = F.coalesce(F.sum("true"), F.lit(0.0))
    return both.agg(F.round(F.when(total < 0.01, F.lit(float("inf"))).otherwise(F.sum("distance") / total), 6).alias("rel"))


def percentiles(times: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, population deviation and interpolated percentiles 50, 95, 99 and 99.9, in thousandths."""
    each = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return times.groupBy(by).agg(
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("std"),
        *[F.round(F.percentile(value, p) * 1000, 4).alias(n) for n, p in each.items()],
    )


def best_of_runs(times: DataFrame, run: str, by: str, value: str) -> DataFrame:
    """Per group the smallest mean of any run, and the queries a second it allows."""
    means = times.groupBy(by, run).agg(F.avg(value).alias("mean"))
    return means.groupBy(by).agg(F.round(F.min("mean"), 6).alias("best"), F.round(F.coalesce(F.try_divide(F.lit(1.0), F.min("mean")), F.lit(0.0)), 6).alias("qps"))


def pareto(points: DataFrame, x: str, y: str, x_larger: bool = True, y_larger: bool = True) -> DataFrame:
    """Rows whose x beats that of every row with a better y; rows with a zero or null coordinate are dropped.

    One row per y goes to the ordered window, after an aggregation by y.
    """
    best = (F.max if x_larger else F.min)(x)
    rows = points.where((F.col(x) != 0) & (F.col(y) != 0)).groupBy(y).agg(best.alias(x))
    order = Window.orderBy(F.col(y).desc() if y_larger else F.col(y).asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = (F.max if x_larger else F.min)(x).over(order)
    beats = F.col(x) > before if x_larger else F.col(x) < before
    return rows.withColumn("_keep", F.coalesce(beats, F.lit(True))).where("_keep").drop("_keep")


#: What a metric of approximate search means: its worst value and whether larger values are better.
REGISTRY = {
    "recall": ("share of the true neighbours' distances reached", 0.0, True),
    "epsilon_01": ("recall with distances 1 per cent larger", 0.0, True),
    "epsilon_10": ("recall with distances 10 per cent larger", 0.0, True),
    "rel": ("relative error of distances", float("inf"), False),
    "qps": ("queries a second", 0.0, True),
    "p50": ("median of times, in thousandths", float("inf"), False),
    "p95": ("95th percentile of times, in thousandths", float("inf"), False),
    "p99": ("99th percentile of times, in thousandths", float("inf"), False),
}


def all_metrics(truth: DataFrame, hits: DataFrame, times: DataFrame, k: int) -> DataFrame:
    """One row per run with every metric of ``REGISTRY``; ``hits`` has run, qid, rank, distance, ``times`` run and seconds.

    All metrics come from one join of the hits with the limits of their queries and one aggregation.
    """
    limit = truth.where(F.col("rank") == k).select("qid", F.col("distance").alias("limit"))
    true = truth.where(F.col("rank") <= k).select("qid", "rank", F.col("distance").alias("true"))
    queries = limit.agg(F.count(F.lit(1)).alias("n"))
    near = hits.where(F.col("rank") <= k).join(limit, "qid").join(true, ["qid", "rank"], "left")
    within = lambda x: F.count_if(F.col("distance") <= x) / k
    total = F.coalesce(F.sum("true"), F.lit(0.0))
    found = near.groupBy("run").agg(
        within(F.col("limit") + 1e-3).alias("recall"), within(F.col("limit") * 1.01).alias("epsilon_01"), within(F.col("limit") * 1.1).alias("epsilon_10"),
        F.when(total < 0.01, F.lit(float("inf"))).otherwise(F.sum(F.when(F.col("true").isNotNull(), F.col("distance"))) / total).alias("rel"),
    )
    speed = times.groupBy("run").agg(
        ratio(F.lit(1.0), F.avg("seconds")).alias("qps"), *[(F.percentile("seconds", p) * 1000).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    )
    recalls = [F.round(F.col(m) / F.col("n"), 6).alias(m) for m in ("recall", "epsilon_01", "epsilon_10")]
    return found.crossJoin(F.broadcast(queries)).join(speed, "run").select("run", *recalls, *[F.round(m, 6).alias(m) for m in ("rel", "qps", "p50", "p95", "p99")])


def padded(hits: DataFrame, count: int) -> DataFrame:
    """(qid, neighbors, distances) of exactly ``count`` entries, missing ones -1 and infinite."""
    lists = hits.where(F.col("rank") <= count).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "did", "distance"))).alias("x"))
    missing = F.lit(count) - F.size("x")
    return lists.select(
        "qid",
        F.concat(F.transform("x", lambda h: h["did"].cast("long")), F.array_repeat(F.lit(-1).cast("long"), missing)).alias("neighbors"),
        F.concat(F.transform("x", lambda h: h["distance"].cast("double")), F.array_repeat(F.lit(float("inf")), missing)).alias("distances"),
    )


def profile(runs: DataFrame, by: str, queries: str, seconds: str) -> DataFrame:
    """Queries, seconds and queries a second of each group; 0 where no time passed."""
    return runs.groupBy(by).agg(F.sum(queries).alias("queries"), F.round(F.sum(seconds), 6).alias("seconds"), F.round(ratio(F.sum(queries), F.sum(seconds)), 6).alias("qps"))


def evaluated(runs: dict[str, DataFrame], qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A wide row for each method's run, in one job: the runs are one table, their queries told apart by method."""
    parts = [run.select(F.struct(F.lit(m).alias("method"), F.col("qid").alias("qid")).alias("qid"), "did", "rank") for m, run in runs.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    asked = whole.select("qid").distinct().select("qid", F.col("qid.qid").alias("q"))
    relevant = asked.join(qrels.select(F.col("qid").alias("q"), "did"), "q").select("qid", "did")
    q = per_query(whole, relevant, ks).withColumn("method", F.col("qid.method"))
    values = {"mrr": ratio(F.lit(1.0), F.col("first_rank")), "ndcg": ratio(F.col("dcg"), F.col("ideal")), "precision": ratio(F.col("n_hits"), F.col("k")), "recall": ratio(F.col("n_hits"), F.col("n_relevant")), "hit_rate": (F.col("n_hits") > 0).cast("double")}
    long = q.select("method", "k", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])).alias("x"))
    return wide(long.groupBy("method", "x.metric", "k").agg(F.round(F.avg("x.value"), 6).alias("value")))

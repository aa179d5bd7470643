"""Relational operators of the query service: first and last of groups, paging, flags, context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group (a window over the keys; ties must be broken by the order)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def page(df: DataFrame, skip: int, take: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(take)


def flagged(df: DataFrame, marks: DataFrame, key: str, flag: str) -> DataFrame:
    """``flag`` tells whether a row's key stands among the marks; a rewrite of the table, not an update in place."""
    keys = marks.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def json_flag(json: str, path: str) -> Column:
    """A boolean of a JSON text, false where it is missing."""
    return F.coalesce(F.get_json_object(json, path) == "true", F.lit(False))


def first_of_text(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, copies) of the first row of each distinct text, by key, with the number of rows that have the text.

    Texts are compared by digests, so they do not cross the network, and counts are combined before the shuffle.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return df.groupBy(digest.alias("_digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).drop("_digest")


def assembled_context(hits: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """References of each query: top hits, joined with documents, defaults for what is missing, the first of equal texts.

    The limit comes before duplicates go.
    """
    top = hits.where(F.col("rank") <= limit)
    joined = top.join(documents, "did", "left")
    doi = F.coalesce("doi", F.lit("Unknown"))
    url = F.coalesce("url", F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), F.col("doi"))), F.lit("Unknown"))
    refs = joined.select("qid", "rank", "did", F.coalesce("title", F.lit("Unknown")).alias("title"), url.alias("url"), doi.alias("doi"), F.coalesce("text", F.lit("")).alias("text"))
    return first_by(refs, ["qid", "text"], F.col("rank"))


def merged_datasets(one: DataFrame, two: DataFrame, key: str, prefix: str = "ds2_") -> DataFrame:
    """Union of two tables; ids of the second that clash get a prefix, which is the same in every run."""
    taken = one.select(key).distinct().withColumn("_taken", F.lit(True))
    renamed = two.join(taken, key, "left").withColumn(key, F.when(F.col("_taken"), F.concat(F.lit(prefix), F.col(key))).otherwise(F.col(key))).drop("_taken")
    return one.unionByName(renamed)


def merged_retrieval_sets(one: tuple[DataFrame, DataFrame, DataFrame], two: tuple[DataFrame, DataFrame, DataFrame], prefix: str = "ds2_") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (qid, text), corpus (did, text) and judgements (qid, did) of two data sets; ids of the second that clash are
    renamed in its tables and in its judgements alike."""
    queries, corpus = merged_datasets(one[0], two[0], "qid", prefix), merged_datasets(one[1], two[1], "did", prefix)
    judgements = two[2]
    for key, k in (("qid", 0), ("did", 1)):
        taken = one[k].select(key).distinct().withColumn("_taken", F.lit(True))
        judgements = judgements.join(taken, key, "left").withColumn(key, F.when(F.col("_taken"), F.concat(F.lit(prefix), F.col(key))).otherwise(F.col(key))).drop("_taken")
    return queries, corpus, one[2].unionByName(judgements)


def scoped(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal all given values."""
    for column, value in equal.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def with_content(df: DataFrame, text: str, least: int, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows, in order, whose trimmed text has at least ``least`` characters."""
    return df.where(F.length(F.trim(text)) >= least).orderBy(*order).limit(most)


def with_children(parents: DataFrame, children: DataFrame, key: str, child: Column, name: str) -> DataFrame:
    """Parents with the sorted list of their children; an empty list where there is none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(child)).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))


def enriched(df: DataFrame, items: str, settings: str, key: str = "configuration_id", value: str = "configuration") -> DataFrame:
    """Fills ``value`` of the structs in ``items`` from a map by ``key``, only where it is missing and known."""
    filled = lambda x: x.withField(value, F.coalesce(x[value], F.try_element_at(F.col(settings), x[key])))
    return df.withColumn(items, F.transform(items, filled))


def matched_files(files: DataFrame, sources: DataFrame, name: str, key: Column, value: str) -> DataFrame:
    """Files with the source whose key equals the file's name, both reduced to letters and digits; of sources with equal keys the
    one with the greatest ``value`` counts."""
    known = sources.groupBy(T.alnum_key(key).alias("_key")).agg(F.max(value).alias(value))
    return files.withColumn("_key", T.alnum_key(name)).join(known, "_key", "left").drop("_key")


def with_first(df: DataFrame, others: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Left join with the first of the others' rows of each key."""
    return df.join(first_by(others, keys, *order), keys, "left")


def runnable(definitions: DataFrame, done: DataFrame, available: DataFrame, key: str = "name", names: list[str] | None = None, disabled: str = "disabled") -> DataFrame:
    """Definitions that are available, not disabled, not yet done and, if names are given, among these."""
    left = definitions.where(~F.coalesce(F.col(disabled), F.lit(False)))
    left = left if names is None else left.where(F.col(key).isin(names))
    return left.join(available.select(key).distinct(), key, "left_semi").join(done.select(key).distinct(), key, "left_anti")


def shuffled(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows in an order that looks random and is the same in every run: by md5 of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def agent_reference(sources: Column, title: Column, content: Column) -> Column:
    """Title, link of the first of several sources (literals between ``;{``) and text of a JSON content, with defaults."""
    first = F.split_part(F.coalesce(sources, F.lit("")), F.lit(";{"), F.lit(1))
    link = F.regexp_extract(first, r"""['"]link['"]\s*:\s*['"]([^'"]*)['"]""", 1)
    return F.struct(F.coalesce(title, F.lit("Unknown")).alias("title"), link.alias("url"), F.coalesce(F.get_json_object(content, "$.text"), F.lit("")).alias("text"))


def split_by_count(df: DataFrame, key: str, test_rows: int, seed: str = "1") -> DataFrame:
    """``part`` is test for the ``test_rows`` rows with the smallest md5(key, seed), else train."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    chosen = df.select(key).orderBy(digest, key).limit(test_rows).withColumn("part", F.lit("test"))
    return df.join(chosen, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def split_by_hash(df: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """``part`` is train for exactly int(n * share) rows in the order of md5(key, seed), else val.

    The threshold is the digest of that rank; ranks are counted by buckets of the digest, so no task sorts all rows.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))))
    bucket = F.substring("_h", 1, 3)
    counts = hashed.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * share).alias("_take"))
    ranked = hashed.withColumn("_b", bucket).join(F.broadcast(before.crossJoin(total)), "_b")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return ranked.withColumn("part", F.when(place <= F.col("_take"), "train").otherwise("val")).drop("_h", "_b", "_n", "_before", "_take")

"""Writers: retrieval data sets, reports, versioned graphs, delimited lists, JSON objects."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, prefix: str = "test") -> None:
    """corpus and queries as JSON lines (_id, title, text), judgements as tab-separated values with a header."""
    corpus.select(F.col("did").cast("string").alias("_id"), F.coalesce("title", F.lit("")).alias("title"), "text").write.mode("overwrite").json(f"{folder}/corpus")
    queries.select(F.col("qid").cast("string").alias("_id"), "text").write.mode("overwrite").json(f"{folder}/{prefix}-queries")
    qrels.select(F.col("qid").alias("query-id"), F.col("did").alias("corpus-id"), F.lit(1).alias("score")).write.mode("overwrite").csv(f"{folder}/qrels/{prefix}", sep="\t", header=True)


def report(metrics: DataFrame, folder: str, by: str = "mrr_at_10") -> DataFrame:
    """A wide table of methods, best first, as CSV with a header; returns it."""
    ordered = metrics.orderBy(F.col(by).desc(), "method")
    ordered.coalesce(1).write.mode("overwrite").csv(folder, header=True)  # a row a method
    return ordered


def appended(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """Appends to a CSV folder with a fixed order of columns."""
    rows.select(*columns).write.mode("append").csv(folder, header=True)


def run_results(hits: DataFrame, folder: str) -> None:
    """Hits of runs, partitioned by data set, count and algorithm."""
    hits.write.mode("append").partitionBy("dataset", "count", "algo").parquet(folder)


def objects(rows: DataFrame, folder: str) -> None:
    """A JSON object a row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def delimited(rows: DataFrame, folder: str, separator: str = ",") -> None:
    rows.write.mode("overwrite").csv(folder, sep=separator, quote="|", header=True)


def collection(vectors: DataFrame, folder: str, name: str) -> None:
    """Drops and writes anew one collection of vectors."""
    vectors.write.mode("overwrite").parquet(f"{folder}/collection={name}")


def next_version(spark: SparkSession, folder: str, prefix: str) -> int:
    """The first free version number of ``{prefix}_v{N}`` folders."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 1
    while store.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{prefix}_v{n}")):
        n += 1
    return n


def graph(nodes: DataFrame, edges: DataFrame, folder: str, prefix: str = "kg") -> str:
    """Nodes and edges in the next free version's folder; returns it."""
    out = f"{folder}/{prefix}_v{next_version(nodes.sparkSession, folder, prefix)}"
    nodes.write.parquet(f"{out}/nodes")
    edges.write.parquet(f"{out}/edges")
    return out


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those already written: a job that broke off goes on here."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def document_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (authors, sources as arrays) and their tags, from semicolon lists; empty tags are dropped."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    documents = raw.select("doc_id", "title", parts("authors").alias("authors"), parts("sources").alias("sources"))
    given = raw.select("doc_id", F.explode(parts("tags")).alias("tag"), F.lit("given").alias("kind"))
    made = raw.select("doc_id", F.explode(parts("generated_tags")).alias("tag"), F.lit("generated").alias("kind"))
    return documents, given.unionByName(made)


def inserted(rows: DataFrame, url: str, table: str, batch: int = 11, **options: str) -> None:
    """Appends rows to a database table in batches."""
    rows.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch, **options).save()


def inserted_sqlite(rows: DataFrame, path: str, table: str, batch: int = 30) -> None:
    """Appends rows to a SQLite table in batches, one writer at a time: SQLite takes no more."""
    names = rows.columns
    sql = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})"

    def run(found: Iterator[Row]) -> None:
        import sqlite3

        with sqlite3.connect(path, timeout=60) as c:
            held = []
            for r in found:
                held.append(tuple(r))
                if len(held) >= batch:
                    c.executemany(sql, held)
                    held = []
            c.executemany(sql, held)

    rows.coalesce(1).foreachPartition(run)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of ``changes`` replaced in the rows of equal key: a rewrite, not an update in place."""
    names = [c for c in changes.columns if c != key]
    news = changes.select(key, F.struct(*names).alias("_new"))
    joined = table.join(news, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with ``rows`` in place of those of equal key, and added where there is none."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)


def qa_json(queries: DataFrame, corpus: DataFrame, judgements: DataFrame, folder: str) -> None:
    """A data set of queries, corpus and relevant documents as JSON lines, one object an entry."""
    queries.select(F.to_json(F.struct(F.lit("query").alias("kind"), "qid", "text")).alias("value")).unionByName(
        corpus.select(F.to_json(F.struct(F.lit("document").alias("kind"), "did", "text")).alias("value"))
    ).unionByName(
        judgements.groupBy("qid").agg(F.sort_array(F.collect_list("did")).alias("relevant")).select(F.to_json(F.struct(F.lit("relevant").alias("kind"), "qid", "relevant")).alias("value"))
    ).write.mode("overwrite").text(folder)


def metrics_table(runs: DataFrame, folder: str) -> DataFrame:
    """All runs' metrics (dataset, algorithm, parameters and one column a metric) as CSV, ordered; returns them."""
    ordered = runs.orderBy("dataset", "algorithm", "parameters")
    ordered.coalesce(1).write.mode("overwrite").csv(folder, header=True)  # a row a run
    return ordered


def result_path(dataset: str, count: int, algorithm: str, arguments: list[object], batch: bool = False) -> str:
    """Folder of a run's results, its arguments made fit for a path."""
    import json
    import re

    name = re.sub(r"\W+", "_", json.dumps(arguments, sort_keys=True)).strip("_")
    return f"{dataset}/{count}/{algorithm}{'-batch' if batch else ''}/{name}"


def markdown_files(pages: DataFrame, folder: str) -> None:
    """A folder of Markdown for each document: (doc_id, markdown)."""
    pages.select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(folder)

"""Plug-in surface, sinks with state and the readers of vector files."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from loomwork import plugins
from loomwork.operators import content
from loomwork.sources import readers, writers


def test_retrievers_and_rerankers_by_name(spark):
    corpus = spark.createDataFrame([(1, "red loom", [1.0, 0.0]), (2, "blue loom weft", [0.0, 1.0]), (3, "green warp", [0.7, 0.7])], "did long, text string, embedding array<double>")
    queries = spark.createDataFrame([(1, "blue weft", [0.1, 0.9])], "qid long, text string, embedding array<double>")
    lexical = plugins.made("retriever", {"name": "bm25", "k1": 1.5}).rank(queries, corpus, 2)
    dense = plugins.made("retriever", {"name": "dense"})
    assert lexical.where("rank = 1").first().did == 2 and [r.did for r in dense.rank(queries, corpus, 3).orderBy("rank").collect()] == [2, 3, 1]
    qrels = spark.createDataFrame([(1, 2)], "qid long, did long")
    assert {(r.metric, r.k): r.value for r in dense.evaluate(queries, corpus, qrels, 3).collect()}["mrr", 1] == 1.0
    reranker = plugins.Reranker(lambda q, t: F.length(t).cast("double"))
    assert [r.did for r in reranker.rerank(dense.rank(queries, corpus, 3), queries, corpus, 2).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(ValueError):
        plugins.made("retriever", {"name": "none"})


def test_indexes_chains_embeddings_and_tools(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "vec_id long, embedding array<double>")
    index = plugins.made("index", {"name": "flat"}).fit(vectors).with_arguments(metric="euclidean")
    assert [r.did for r in index.search(vectors.where("vec_id = 0"), 2).orderBy("rank").collect()] == [1, 2]
    assert plugins.chain([lambda d: d.where("vec_id > 2"), lambda d: d.where("vec_id < 5")])(vectors).count() == 2 and plugins.chain([])(vectors) is vectors
    made = plugins.embedded(spark.createDataFrame([("ab",), (None,)], "text string"), lambda: lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r.embedding[0] for r in made.collect()) == [0.0, 2.0]
    assert plugins.tool(lambda: vectors.where("vec_id = 1"))() == [{"vec_id": 1, "embedding": [1.0, 1.0]}]


def test_sinks_with_state(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a INT, b TEXT)")
    rows = spark.createDataFrame([(k, f"b{k}") for k in range(25)], "a int, b string")
    writers.inserted_sqlite(rows, path, "t", 11)
    assert readers.sqlite_tables(spark, [path], "t", "a int, b string").count() == 25
    changes = spark.createDataFrame([(3, "new"), (99, "added")], "a int, b string")
    assert {r.a: r.b for r in writers.updated(rows, changes, "a").collect()}[3] == "new" and writers.updated(rows, changes, "a").count() == 25
    assert {r.a: r.b for r in writers.upserted(rows, changes, "a").collect()} | {} == {k: f"b{k}" for k in range(25)} | {3: "new", 99: "added"}
    writers.objects(rows, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 25
    writers.collection(rows, str(tmp_path / "v"), "one")
    assert spark.read.parquet(str(tmp_path / "v")).where("collection = 'one'").count() == 25
    writers.delimited(rows, str(tmp_path / "d"), ";")
    assert readers.delimited(spark, str(tmp_path / "d"), ";").count() == 25
    assert readers.column_at(rows, -1).columns == ["b"]
    writers.appended(rows.limit(2), str(tmp_path / "a"), ["b", "a"])
    writers.appended(rows.limit(1), str(tmp_path / "a"), ["b", "a"])
    assert spark.read.csv(str(tmp_path / "a"), header=True).columns == ["b", "a"]
    hits = spark.createDataFrame([("d", 10, "x", 1, 2)], "dataset string, count int, algo string, qid int, did int")
    writers.run_results(hits, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().algo == "x" and writers.result_path("d", 10, "ivf", [{"lists": 4}], True) == "d/10/ivf-batch/lists_4"
    table = spark.createDataFrame([("m1", 0.2), ("m2", 0.9)], "method string, mrr_at_10 double")
    assert [r.method for r in writers.report(table, str(tmp_path / "rep")).collect()] == ["m2", "m1"]
    q, d, j = (spark.createDataFrame(x, s) for x, s in (([("q", "t")], "qid string, text string"), ([("d", "t", None)], "did string, text string, title string"), ([("q", "d")], "qid string, did string")))
    writers.qa_json(q, d, j, str(tmp_path / "qa"))
    writers.beir(d, q, j, str(tmp_path / "beir"))
    assert spark.read.json(str(tmp_path / "qa")).count() == 3 and spark.read.json(str(tmp_path / "beir/corpus")).first()._id == "d"
    writers.metrics_table(spark.createDataFrame([("d", "a", "p", 1.0)], "dataset string, algorithm string, parameters string, recall double"), str(tmp_path / "m"))
    writers.markdown_files(spark.createDataFrame([("d1", "# x")], "doc_id string, markdown string"), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).first().value == "# x"
    raw = spark.createDataFrame([("d1", "t", "A; B", "s", "x;;y", None)], "doc_id string, title string, authors string, sources string, tags string, generated_tags string")
    documents, tags = writers.document_rows(raw)
    assert documents.first().authors == ["A", "B"] and tags.count() == 2


def test_vector_files(spark, tmp_path):
    (tmp_path / "v.fvecs").write_bytes(b"".join(struct.pack("<i2f", 2, k, k + 0.5) for k in range(3)))
    assert [r.vector for r in readers.binary_vectors(spark, str(tmp_path / "v.fvecs")).orderBy("index").collect()] == [[0.0, 0.5], [1.0, 1.5], [2.0, 2.5]]
    (tmp_path / "i.idx").write_bytes(bytes([0, 0, 8, 3]) + struct.pack(">3I", 2, 1, 2) + bytes([1, 2, 3, 4]))
    assert [r.vector for r in readers.idx_images(spark, str(tmp_path / "i.idx")).orderBy("index").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert readers.named_vectors(lines("w 1 2")).first().vector == [1.0, 2.0] and readers.id_sets(lines("3 1 3")).first().items == [3, 1]
    assert readers.ratings(lines("1::5::4", "1::6::2")).first().items == [5] and readers.bags_of_words(lines("7", "1 2 3")).first().n == 3
    bits = readers.text_vectors(lines("0110 1"), "bit")
    assert bits.first().vector == [0, 1, 1, 0, 1] and readers.written_bits(bits).first().value == "0110 1" and readers.dimension(bits) == 5
    assert readers.written_vectors(readers.text_vectors(lines("1 2"), "int")).first().value == "1 2"
    assert [r.page for r in readers.page_numbers(spark, 5, 1, 2, True).collect()] == [5, 4]
    v = readers.synthetic_vectors(spark, 20, 3)
    assert v.count() == 20 and set(readers.bit_strings(v).first().vector) <= {0, 1}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    assert readers.files_of(spark, str(tmp_path / "f"), "*.txt", 1).count() == 1
    (tmp_path / "x.xml").write_text("<r><e><a>1</a></e><e><a>2</a></e></r>")
    assert readers.xml_rows(spark, str(tmp_path / "x.xml"), "e", "a int").count() == 2


def test_fetching_and_configurations(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("no")
        return f"<p>{url}</p>"

    got = {r.url: r.html for r in readers.fetched(spark.createDataFrame([("ok",), ("bad",)], "url string"), fetch, wait=lambda s: None).collect()}
    assert got == {"ok": "<p>ok</p>", "bad": None}
    assert readers.only_entry({"splitter": {"words": {"size": 3}}}, "splitter") == ("words", {"size": 3})
    with pytest.raises(ValueError):
        readers.only_entry({"splitter": {}}, "splitter")
    assert [n for n, _ in readers.until_empty(range(1, 9), lambda n: [n] if n < 4 else [])] == [1, 2, 3]
    assert readers.substituted([{"d": "@dimension"}, "x"], {"@dimension": 8}) == [{"d": 8}, "x"]


def test_joined_results_carry_fragments_over_boxes(spark):
    zone = lambda paragraphs, last=None: {"layout_type": "LEFT", "paragraphs": paragraphs, "last_text_fragment": last}
    import json

    value = {"pages": [{"page_number": 1, "zones": [zone(["one"], "two"), zone(None, "three")]}, {"page_number": 2, "zones": [zone(["Box 1 | x", "four"], "lost")]}], "references": []}
    df = spark.createDataFrame([("a", json.dumps(value)), ("b", "{bad")], "id string, json string")
    assert [(r.id, r.text) for r in content.joined_results(df, "id", "json").collect()] == [("a", "one\n\nBox 1 | x\n\ntwo three four")]

"""Readers: prefixes of text or JSON objects, layout elements, delimited lists, SQLite, vector files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTPROCESS = "pages array<struct<page_number:int,zones:array<struct<layout_type:string,paragraphs:array<string>,last_text_fragment:string>>>>, references array<string>"
ELEMENT = "page_number int, page_width double, top double, left double, width double, height double, type string, text string"
CHAPTERS = "chapters array<struct<type:string,header:struct<extracted_text:string>,elements:array<struct<extracted_text:string>>>>"


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def text_objects(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, source): whole files under a prefix; the id is the name up to its first dot."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.split_part(file_name(), F.lit("."), F.lit(1)).alias("doc_id"), F.col("value").alias("text"), F.lit(path).alias("source"))


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(doc_id, value): JSON files under a prefix; the id is the name without ``.json``, other files are left out."""
    found = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return found.select(name.alias("doc_id"), F.from_json("value", schema).alias("value")).where("doc_id <> ''")


def layout_elements(spark: SparkSession, path: str, rendered_width: float) -> DataFrame:
    """Elements of layout files, boxes scaled to the rendered width and truncated, numbered in order."""
    raw = json_objects(spark, path, f"array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in ELEMENT.split(', '))}>>")
    scale = F.try_divide(F.lit(rendered_width), F.get(F.col("value.page_width"), F.lit(0)))
    each = raw.select("doc_id", scale.alias("scale"), F.posexplode("value").alias("index", "e"))
    cut = lambda x: (x * F.col("scale")).cast("int")
    return each.select(
        "doc_id", "index", F.col("e.page_number").alias("page"), F.col("e.type").alias("kind"), F.col("e.text").alias("text"),
        cut(F.col("e.left")).alias("left"), cut(F.col("e.top")).alias("top"), cut(F.col("e.left") + F.col("e.width")).alias("right"), cut(F.col("e.top") + F.col("e.height")).alias("bottom"),
    )


def delimited(spark: SparkSession, path: str, separator: str = ",", quote: str = "|") -> DataFrame:
    """A list with a header; the one delimiter option serves lists of either kind."""
    return spark.read.csv(path, sep=separator, quote=quote, header=True, multiLine=True)


def files_of(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """(path, length) of files under a folder; ``limit`` takes the first by name, as a directory reader does."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    return found.orderBy("path").limit(limit) if limit else found


def sqlite_tables(spark: SparkSession, paths: list[str], table: str, schema: str, where: str | None = None) -> DataFrame:
    """Rows of a table of SQLite files, read where the tasks run (files on a shared disk), a task a file."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for p in parts:
            for path in p["path"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    if c.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
                        yield from pd.read_sql(f"SELECT {', '.join(names)} FROM {table}" + (f" WHERE {where}" if where else ""), c, chunksize=10_000)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, schema)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database; filters on the result are pushed down by the source."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=row_tag).schema(schema).load(path)


def text_vectors(lines: DataFrame, kind: str = "float", column: str = "value") -> DataFrame:
    """Vectors of text lines: floats or ints between white space, or bits."""
    line = F.trim(F.col(column))
    if kind == "bit":
        return lines.select(F.transform(F.split(F.regexp_replace(line, r"[ \t]", ""), ""), lambda x: x.cast("int")).alias("vector"))
    number = {"float": "double", "int": "int"}[kind]
    return lines.select(F.transform(F.split(line, r"\s+"), lambda x: x.cast(number)).alias("vector"))


def written_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """The inverse of ``text_vectors`` for floats and ints."""
    return vectors.select(F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias("value"))


def named_vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, vector) of lines with a word before its numbers."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("double")).alias("vector"))


def binary_vectors(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(file, index, vector) of files of length-prefixed float (fvecs) or int (ivecs) vectors."""
    code = {"fvecs": "<f4", "ivecs": "<i4"}[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            for file, content in zip(p["path"], p["content"], strict=True):
                if not content:
                    continue
                (dim,) = struct.unpack("<i", content[:4])
                rows = np.frombuffer(content, "<i4").reshape(-1, dim + 1)[:, 1:].copy().view(code)
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame({"file": file, "index": range(k, k + len(rows[k : k + 10_000])), "vector": list(rows[k : k + 10_000].astype("float64"))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, index long, vector array<double>")


def id_sets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sets of ints of lines with ids between spaces."""
    return lines.select(F.array_distinct(F.transform(F.split(F.trim(F.col(column)), r"\s+"), lambda x: x.cast("int"))).alias("items"))


def ratings(lines: DataFrame, separator: str = "::", least: float = 3.0, column: str = "value") -> DataFrame:
    """(user, items): per user the items rated ``least`` or more."""
    p = F.split(F.col(column), separator)
    rows = lines.select(p[0].cast("long").alias("user"), p[1].cast("long").alias("item"), p[2].cast("double").alias("rating")).where(F.col("rating") >= least)
    return rows.groupBy("user").agg(F.array_sort(F.collect_set("item")).alias("items"))


def page_numbers(spark: SparkSession, start: int, last: int, limit: int | None = None, backwards: bool = False) -> DataFrame:
    """The pages of a paged listing, in either direction, at most ``limit``."""
    numbers = list(range(start, last - 1, -1) if backwards else range(start, last + 1))
    return spark.createDataFrame([(n,) for n in (numbers if limit is None else numbers[:limit])], "page int")


def until_empty(numbers: Iterable[int], rows_of: Callable[[int], list]) -> Iterator[tuple[int, list]]:
    """Pages of a listing with their rows, up to the first without any."""
    for n in numbers:
        found = rows_of(n)
        if not found:
            return
        yield n, found


def synthetic_vectors(spark: SparkSession, n: int, dim: int, centres: int = 10, seed: int = 1) -> DataFrame:
    """Gaussian blobs around ``centres`` points."""
    base = spark.range(n).withColumn("label", (F.col("id") % centres).cast("int"))
    parts = [F.randn(seed + k) * 0.3 + F.sin(F.col("label") * (k + 1)) for k in range(dim)]
    return base.select("id", "label", F.array(*parts).alias("vector"))


def bit_strings(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors of 0 and 1 by the signs of numbers."""
    return vectors.withColumn(column, F.transform(column, lambda x: (x > 0).cast("int")))


def written_bits(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """The inverse of ``text_vectors`` for bits: four digits, then a space."""
    digits = F.array_join(F.transform(column, lambda x: x.cast("string")), "")
    return vectors.select(F.rtrim(F.regexp_replace(digits, "(.{4})", "$1 ")).alias("value"))


def idx_images(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, vector) of IDX files of unsigned bytes: each item of the first dimension is one vector."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        import numpy as np

        for p in parts:
            for file, content in zip(p["path"], p["content"], strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                rank = raw[3]
                shape = struct.unpack(f">{rank}I", raw[4 : 4 + 4 * rank])
                rows = np.frombuffer(raw, np.uint8, offset=4 + 4 * rank).reshape(shape[0], -1)
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame({"file": file, "index": range(k, k + len(rows[k : k + 10_000])), "vector": list(rows[k : k + 10_000].astype("float64"))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, index long, vector array<double>")


def bags_of_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """(doc, word, n) of lines with three numbers; other lines, such as the head, are left out."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.where(F.size(parts) == 3).select(*[F.get(parts, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("doc", "word", "n"))])


def dimension(vectors: DataFrame, column: str = "vector") -> int | None:
    """Length of the first vector; null for an empty table."""
    row = vectors.select(F.size(column).alias("n")).first()
    return row.n if row else None


def fetched(urls: DataFrame, fetch, attempts: int = 3, wait=None, column: str = "url") -> DataFrame:
    """(url, html): what ``fetch(url)`` gives; after a failure it waits the square of the attempt in seconds, and after the last
    the text is null."""
    import time

    pause = wait or time.sleep

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for url in p["url"]:
                text = None
                for k in range(1, attempts + 1):
                    try:
                        text = fetch(url)
                        break
                    except OSError:
                        if k < attempts:
                            pause(k * k)
                out.append((url, text))
            yield pd.DataFrame(out, columns=["url", "html"])

    return urls.select(F.col(column).alias("url")).mapInPandas(run, "url string, html string")


def only_entry(config: dict, section: str) -> tuple[str, dict]:
    """Name and arguments of the one entry of a configuration's section; none or several raise."""
    entries = config.get(section) or {}
    if len(entries) != 1:
        raise ValueError(f"{section} must have exactly one entry, not {len(entries)}")
    return next(iter(entries.items()))


def substituted(arguments: object, values: dict[str, object]) -> object:
    """Arguments with names like ``@dimension`` replaced by values, in lists and dictionaries alike."""
    if isinstance(arguments, dict):
        return {k: substituted(v, values) for k, v in arguments.items()}
    if isinstance(arguments, list):
        return [substituted(v, values) for v in arguments]
    return values.get(arguments, arguments) if isinstance(arguments, str) else arguments


def column_at(df: DataFrame, position: int) -> DataFrame:
    """The column at a position, from the end if it is negative."""
    return df.select(df.columns[position])

"""Contents of parsed documents: postprocessing results, chapters, TEI references, definition lists, Markdown, QA records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import folds
from loomwork.operators.markup import cleaned
from loomwork.sources.readers import CHAPTERS, POSTPROCESS


def joined_results(results: DataFrame, key: str, json: str) -> DataFrame:
    """(key, text) of postprocessing results in JSON: paragraphs in order, two line breaks between them.

    A zone's last fragment is put before the next paragraph that is no box header, after earlier fragments that still
    wait; fragments that nothing follows are left out.  Texts that are no JSON give no row.
    """
    parsed = results.select(key, F.from_json(json, POSTPROCESS).alias("v")).where("v.pages is not null")
    zones = parsed.select(key, F.posexplode_outer("v.pages").alias("p", "page")).select(key, "p", F.posexplode_outer("page.zones").alias("z", "zone"))
    piece = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    paragraphs = F.coalesce(F.transform("zone.paragraphs", lambda t: piece("P", t)), none)
    fragment = F.when(F.coalesce(F.col("zone.last_text_fragment"), F.lit("")) != "", F.array(piece("F", F.col("zone.last_text_fragment")))).otherwise(none)
    items = zones.select(key, "p", "z", F.posexplode_outer(F.concat(paragraphs, fragment)).alias("k", "item")).select(key, "p", "z", "k", "item.kind", "item.text")
    box = (F.col("kind") == "P") & T.is_box_header("text")
    takes = (F.col("kind") == "P") & ~box
    before = Window.partitionBy(key).orderBy("p", "z", "k").rowsBetween(Window.unboundedPreceding, -1)
    marked = items.withColumn("box", box).withColumn("group", F.coalesce(F.sum(takes.cast("int")).over(before), F.lit(0)))
    at = F.struct("p", "z", "k")
    grouped = marked.groupBy(key, "group", F.when(F.col("box"), at).alias("own")).agg(
        F.sort_array(F.collect_list(F.struct("p", "z", "k", "text"))).alias("x"), F.max(F.when(F.col("kind") == "P", at)).alias("at")
    )
    texts = grouped.select(key, F.when(F.col("at").isNotNull(), F.struct("at", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))).alias("t"))
    whole = texts.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(key, F.array_join(F.transform("t", lambda t: t["text"]), "\n\n").alias("text"))


def chapter_nodes(documents: DataFrame, key: str, json: str, least: int = 500) -> DataFrame:
    """(doc, seq, text) of the chapters in JSON documents, short ones merged; texts that are no JSON give no row."""
    chapters = documents.select(key, F.posexplode(F.from_json(json, CHAPTERS)["chapters"]).alias("seq", "c"))
    plain = chapters.select(key, "seq", F.col("c.type").alias("kind"), F.col("c.header.extracted_text").alias("header"), F.transform("c.elements", lambda e: F.coalesce(e["extracted_text"], F.lit(""))).alias("parts"))
    return folds.merged_chapters(plain, key, "seq", "kind", "header", "parts", least)


REFERENCES = "refs array<struct<title:string,doi:string,publisher:string,published_date:string,authors:array<string>>>, raw_refs array<string>, content array<struct<type:string,content:string>>"


def parse_tei_references(xml: str | None) -> dict | None:
    """References, raw references and the typed stream of contents of a TEI document; null for text that is no XML."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    text = lambda e: None if e is None else "".join(e.itertext())
    refs, raw = [], []
    for b in root.iter("biblStruct"):
        authors = [" ".join(t.strip() for t in a.itertext()).strip() for a in b.iter("author")]
        refs.append(
            {
                "title": text(next(b.iter("title"), None)),
                "doi": text(next((i for i in b.iter("idno") if i.get("type") == "DOI"), None)),
                "publisher": text(next(b.iter("publisher"), None)),
                "published_date": text(next((d for d in b.iter("date") if d.get("type") == "published"), None)),
                "authors": authors,
            }
        )
        if note := text(next((x for x in b.iter("note") if x.get("type") == "raw_reference"), None)):
            raw.append(note)
    content = [{"type": "abstract", "content": ET.tostring(a, "unicode")} for a in list(root.iter("abstract"))[:1]]
    for body in list(root.iter("body"))[:1]:
        content += [{"type": "div", "content": ET.tostring(d, "unicode")} for d in body.iter("div")]
        content += [{"type": "table", "content": ET.tostring(t, "unicode")} for t in body.iter("figure") if t.get("type") == "table"]
    return {"refs": refs, "raw_refs": raw, "content": content}


def tei_references(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, refs, raw_refs, content), parsed in batches; null fields for texts that are no XML."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [parse_tei_references(x) or {"refs": None, "raw_refs": None, "content": None} for x in p["xml"]]
            yield pd.concat([p[["key"]].reset_index(drop=True), pd.DataFrame(got, columns=["refs", "raw_refs", "content"])], axis=1)

    plain = documents.select(F.col(key).alias("key"), F.col(xml).alias("xml"))
    return plain.mapInPandas(run, f"key {dict(plain.dtypes)['key']}, {REFERENCES}").withColumnRenamed("key", key)


def definition(html: str | Column, label: str, tag: str = "dd") -> Column:
    """Text of the next ``tag`` after the ``dt`` with the label; null where there is none."""
    found = F.regexp_extract(cleaned(html), rf"(?is)<dt\b[^>]*>\s*{re.escape(label)}\s*</dt>(?:(?!<{tag}\b).)*<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return _plain(found)


def _plain(markup: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(markup, r"(?s)<[^>]*>", ""), r"\s+", " "))
    return F.when(text != "", text)


def class_text(html: str | Column, tag: str, name: str, missing: str) -> Column:
    """Text of the first ``tag`` element that has the class, else a literal."""
    found = F.regexp_extract(cleaned(html), rf'(?is)<{tag}\b[^>]*\bclass="(?:[^"]*\s)?{re.escape(name)}(?:\s[^"]*)?"[^>]*>(.*?)</{tag}>', 1)
    return F.coalesce(_plain(found), F.lit(missing))


def resolved_links(links: DataFrame, publishers: DataFrame, base: str, wiley_base: str) -> DataFrame:
    """Download links of result cards (link, button): the link itself where it names a PDF; for views the DOI's publisher is
    looked up (doi, publisher) and decides."""
    doi = F.array_join(F.slice(F.split(F.regexp_replace("link", "/+$", ""), "/"), -2, 2), "/")
    asked = links.withColumn("doi", F.when(F.col("button") == "View", doi))
    known = asked.join(publishers.select("doi", "publisher"), "doi", "left")
    pdf = F.when((F.col("button") == "Download") & F.contains("link", F.lit("pdf")), F.col("link"))
    pdf = pdf.when(F.col("publisher") == "Wiley", F.concat(F.lit(f"{wiley_base}/"), F.url_encode("doi")))
    crossref = F.when(F.col("publisher").isNotNull(), F.concat(F.lit(f"{base}/"), F.col("doi")))
    return known.select(*links.columns, "publisher", pdf.alias("pdf_download_link"), crossref.alias("crossref_metadata_url"))


def harvested_links(html: str | Column, inside: str = "span") -> Column:
    """Targets of the links that hold an element ``inside``, in order."""
    each = F.regexp_extract_all(cleaned(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)
    return F.transform(F.filter(each, lambda a: a.rlike(rf"(?is)<{inside}\b")), lambda a: F.regexp_extract(a, r'(?is)\bhref="([^"]*)"', 1))


def page_text(html: str | Column) -> Column:
    """The whole text of a page, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(cleaned(html), r"(?s)<[^>]*>", " "), r"\s+", " "))


def markdown(html: str | Column) -> Column:
    """Headings, paragraphs, list items, links and emphasis of a page as Markdown; other markup is dropped."""
    x = F.regexp_replace(cleaned(html), r"\s+", " ")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?i)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    x = F.regexp_replace(x, r'(?i)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    x = F.regexp_replace(x, r"(?i)</?(b|strong)\b[^>]*>", "**")
    x = F.regexp_replace(x, r"(?i)</?(i|em)\b[^>]*>", "*")
    x = F.regexp_replace(x, r"(?i)<li\b[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?i)<br\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?i)</?(p|div|ul|ol|article|section|table|tr)\b[^>]*>", "\n\n")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


QA_RECORD = "user_input string, reference_contexts array<string>, reference_context_ids array<string>"


def qa_dataset(records: DataFrame, json: str, query_id: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, judgements) of QA records in JSON lines.

    Contexts of several hops are split, with ids ``<id>__<n>hop``; a context of one hop keeps its id.  A query's context
    counts as relevant if its id stands in a corpus id.
    """
    parsed = records.select(query_id.alias("qid"), F.from_json(json, QA_RECORD).alias("r")).where("r.user_input is not null")
    pairs = parsed.select("qid", F.explode(F.arrays_zip(F.col("r.reference_context_ids").alias("cid"), F.col("r.reference_contexts").alias("text"))).alias("c")).select("qid", "c.cid", "c.text")
    hops = F.filter(F.transform(T.hop_parts(F.trim("text")), lambda h: F.trim(h)), lambda h: h != "")
    several = F.transform(hops, lambda h, i: F.struct(F.concat("cid", F.lit("__"), (i + 1).cast("string"), F.lit("hop")).alias("did"), h.alias("text")))
    one = F.array(F.struct(F.col("cid").alias("did"), F.coalesce(F.get(hops, F.lit(0)), F.trim("text")).alias("text")))
    corpus = pairs.select(F.explode(F.when(F.size(hops) > 1, several).otherwise(one)).alias("x")).select("x.did", "x.text").groupBy("did").agg(F.max("text").alias("text"))
    return parsed.select("qid", F.col("r.user_input").alias("text")), corpus, pairs.select("qid", "cid").distinct()


def multi_hop_scenarios(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` (source, target, theme) of each edge: themes that both ends have, else the source's first."""
    ends = edges.select("source", "target").join(nodes.select(F.col("id").alias("source"), F.col("themes").alias("a")), "source").join(nodes.select(F.col("id").alias("target"), F.col("themes").alias("b")), "target")
    both = F.array_sort(F.array_intersect("a", "b"))
    themes = F.when(F.size(both) > 0, F.slice(both, 1, most)).otherwise(F.slice(F.array_sort("a"), 1, 1))
    return ends.select("source", "target", F.explode(themes).alias("theme"))


def qa_samples(scenarios: DataFrame, contexts: DataFrame) -> DataFrame:
    """(source, target, theme, context_ids, contexts): the contexts of a scenario's nodes, marked by hop."""
    one, two = (contexts.select(F.col("id").alias(e), F.col("text").alias(f"{e}_text")) for e in ("source", "target"))
    joined = scenarios.join(one, "source").join(two, "target")
    return joined.select("source", "target", "theme", F.array("source", "target").alias("context_ids"), T.with_hop_marks(F.array("source_text", "target_text")).alias("contexts"))

"""Fields of HTML pages and TEI documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(html: str | Column) -> Column:
    """Without comments, scripts and styles."""
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(h, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def element_text(html: str | Column, tag: str) -> Column:
    """Text of the first element of a tag, without markup, spaces collapsed; null where there is none."""
    inner = F.regexp_extract(cleaned(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", ""), r"\s+", " "))
    return F.when(text != "", text)


def attribute(html: str | Column, tag: str, name: str) -> Column:
    found = F.regexp_extract(cleaned(html), rf'(?is)<{tag}\b[^>]*\b{name}="([^"]*)"', 1)
    return F.when(found != "", found)


def links(html: str | Column) -> Column:
    """All link targets in order."""
    return F.regexp_extract_all(cleaned(html), F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"'), 1)


def blocks(html: str | Column, tags: tuple[str, ...] = ("h1", "h2", "h3", "h4", "p", "li")) -> Column:
    """Non-empty texts of closed block elements, in order; figures and frames are dropped with what they hold."""
    kept = F.regexp_replace(cleaned(html), r"(?is)<(figure|iframe)\b[^>]*>.*?</\1>", "")
    found = F.regexp_extract_all(kept, F.lit(rf"(?is)<({'|'.join(tags)})\b[^>]*>(.*?)</\1>"), 2)
    texts = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))
    return F.filter(texts, lambda t: t != "")


TEI = "title string, abstract string, doi string, keywords array<string>, authors array<string>, idnos array<struct<type:string,value:string>>, sections array<struct<head:string,text:string>>, figures array<struct<head:string,text:string>>"


def parse_tei(xml: str | None) -> dict | None:
    """Fields of a TEI document; null for text that is no XML."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    every = lambda e, tag: [x for x in e.iter() if name(x) == tag]
    text = lambda e: " ".join("".join(e.itertext()).split())
    first = lambda tag: next((text(e) for e in every(root, tag)), None)
    idnos = [{"type": e.get("type"), "value": text(e)} for e in every(root, "idno")]
    authors = []
    for a in every(root, "author"):
        names = [text(e) for tag in ("forename", "surname") for e in every(a, tag)[:1]]
        if joined := " ".join(n for n in names if n):
            authors.append(joined)
    title = next((text(t) for s in every(root, "titleStmt") for t in every(s, "title")), None)
    sections = [{"head": next((text(h) for h in d if name(h) == "head"), None), "text": " ".join(text(p) for p in every(d, "p"))} for b in every(root, "body") for d in every(b, "div")]
    return {
        "title": title,
        "abstract": first("abstract"),
        "doi": next((i["value"] for i in idnos if i["type"] == "DOI"), None),
        "keywords": [text(t) for k in every(root, "keywords") for t in every(k, "term")],
        "authors": authors,
        "idnos": idnos,
        "sections": sections,
        "figures": [{"head": next((text(h) for h in f if name(h) == "head"), None), "text": next((text(d) for d in f if name(d) == "figDesc"), None)} for f in every(root, "figure")],
    }


def tei_fields(xml: str | Column) -> Column:
    """Struct of the fields of TEI documents, parsed in Arrow batches."""
    @F.pandas_udf(TEI)
    def parse(texts: pd.Series) -> pd.DataFrame:
        empty = {k: None for k in ("title", "abstract", "doi", "keywords", "authors", "idnos", "sections", "figures")}
        return pd.DataFrame([parse_tei(t) or empty for t in texts], columns=list(empty))

    return parse(F.col(xml) if isinstance(xml, str) else xml)


def section_nodes(fields: DataFrame, key: str, tei: str = "tei") -> DataFrame:
    """(key, seq, tag, text): a node for the title, the abstract and each section; sections without a head are unnamed."""
    head = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"{tei}.{t}").alias("text")) for t in ("title", "abstract")])
    body = F.transform(F.coalesce(F.col(f"{tei}.sections"), F.array()), lambda s: F.struct(F.coalesce(s["head"], F.lit("Unnamed Section")).alias("tag"), s["text"].alias("text")))
    return fields.select(key, F.posexplode(F.concat(head, body)).alias("seq", "node")).select(key, "seq", "node.tag", "node.text").where("text is not null")


def tag_filter(nodes: DataFrame, tags: tuple[str, ...] = ("abstract", "introduction", "discussion"), reverse: bool = False) -> DataFrame:
    """Nodes whose tag is (or, reversed, is not) wanted and whose text is not blank."""
    wanted = F.lower(F.trim("tag")).isin(*tags)
    return nodes.where((~wanted if reverse else wanted) & (F.trim("text") != ""))

"""Ordered folds over the fragments of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_paragraphs(fragments: DataFrame, doc: str, order: str, text: str, complete: Column) -> DataFrame:
    """(doc, number, text, whole): fragments are carried until one is complete; a pending rest has ``whole`` false."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = fragments.withColumn("_done", complete)
    numbered = marked.withColumn("number", F.coalesce(F.sum(F.col("_done").cast("int")).over(before), F.lit(0)))
    grouped = numbered.groupBy(doc, "number").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_x"), F.max("_done").alias("whole"))
    return grouped.select(doc, "number", F.array_join(F.transform("_x", lambda x: x[text]), " ").alias("text"), "whole")


def merged_chapters(chapters: DataFrame, doc: str, order: str, kind: str, header: str, parts: str, least: int = 500, excluded: tuple[str, ...] = ("FIGURE", "TABLE")) -> DataFrame:
    """(doc, seq, text) of chapters with their headers as second-level titles, short ones merged greedily.

    A DEFAULT chapter whose text, header included, has fewer than ``least`` characters takes the next DEFAULT chapters until it has
    as many; chapters of other kinds stand alone, those of ``excluded`` kinds are left out.  ``parts`` is an array of texts: those of a
    chapter that begins a text are joined by line breaks, those of a chapter that is taken by spaces.
    """
    title = F.concat(F.lit("## "), F.coalesce(header, F.lit("")), F.lit("\n\n"))
    plain = chapters.where(~F.col(kind).isin(*excluded)).select(
        F.col(doc).alias("doc"), F.col(order).alias("seq"), F.col(kind).alias("kind"),
        F.concat(title, F.array_join(parts, "\n")).alias("alone"), F.concat(title, F.array_join(parts, " ")).alias("taken"),
    )
    item = F.struct("seq", "kind", F.length("alone").alias("n"))
    # the fold sees sizes alone; it gives the place in the document of the chapter that takes each chapter
    heads = f"""aggregate(x, struct(cast(array() as array<struct<seq:bigint,head:bigint>>) as done, cast(null as bigint) as head, 0 as n),
        (a, c) -> case
            when c.kind <> 'DEFAULT' then struct(concat(a.done, array(struct(cast(c.seq as bigint) as seq, cast(c.seq as bigint) as head))) as done, a.head as head, a.n as n)
            when a.head is not null and a.n < {least} then struct(concat(a.done, array(struct(cast(c.seq as bigint) as seq, a.head as head))) as done, a.head as head, a.n + 2 + c.n as n)
            else struct(concat(a.done, array(struct(cast(c.seq as bigint) as seq, cast(c.seq as bigint) as head))) as done, cast(c.seq as bigint) as head, c.n as n) end, a -> a.done)"""
    owned = plain.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("x")).select("doc", F.explode(F.expr(heads)).alias("h")).select("doc", "h.seq", "h.head")
    joined = plain.withColumn("seq", F.col("seq").cast("long")).join(owned, ["doc", "seq"])
    text = F.when(F.col("seq") == F.col("head"), F.col("alone")).otherwise(F.col("taken")).alias("text")
    grouped = joined.groupBy("doc", F.col("head").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("at"), text))).alias("x"))
    return grouped.select("doc", "seq", F.array_join(F.transform("x", lambda c: c["text"]), "\n\n").alias("text"))


def reference_section(elements: DataFrame, doc: str, order: str, is_title: Column, is_header: Column) -> DataFrame:
    """Marks elements after the reference title and before the next header."""
    position = Window.partitionBy(doc)
    titled = elements.withColumn("_start", F.min(F.when(is_title, F.col(order))).over(position))
    stopped = titled.withColumn("_stop", F.min(F.when(is_header & (F.col(order) > F.col("_start")), F.col(order))).over(position))
    inside = (F.col(order) > F.col("_start")) & (F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return stopped.withColumn("in_references", F.coalesce(inside, F.lit(False))).drop("_start", "_stop")

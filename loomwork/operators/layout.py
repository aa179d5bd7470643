"""Page layout: boxes in zones, nearest edges, the layout cascade and paragraphs of zones.

Boxes are columns left, top, right, bottom within a page (key columns); zones have the same columns with a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T

SIDES = ("left", "top", "right", "bottom")


def scaled(elements: DataFrame, width: str, rendered: float) -> DataFrame:
    """Boxes scaled to the rendered width and truncated toward zero."""
    return elements.withColumns({s: (F.col(s) * F.coalesce(F.try_divide(F.lit(rendered), F.col(width)), F.lit(1.0))).cast("int") for s in SIDES})


def contained(elements: DataFrame, zones: DataFrame, keys: list[str], tolerance: int = 0, more: list[str] | None = None) -> DataFrame:
    """Elements joined with the zones of their page that contain them, give or take the tolerance; ``more`` columns of zones are kept."""
    z = zones.select(*keys, "zone", *(more or []), *[F.col(s).alias(f"zone_{s}") for s in SIDES])
    inside = (
        (F.col("left") >= F.col("zone_left") - tolerance)
        & (F.col("top") >= F.col("zone_top") - tolerance)
        & (F.col("right") <= F.col("zone_right") + tolerance)
        & (F.col("bottom") <= F.col("zone_bottom") + tolerance)
    )
    return elements.join(z, keys).where(inside)


def nearest_edges(elements: DataFrame, keys: list[str], low: int, high: int, middle: int, top: int = 0, bottom: int = 0) -> DataFrame:
    """Per page the nearest box edges above and below a middle row among boxes that meet the slice from low to high.

    Both are the middle row itself where a box covers it; with no box above it is ``top``, with none below ``bottom``.
    Boxes that touch the slice or the row count.
    """
    pages = elements.groupBy(*keys).agg(_boxes().alias("boxes"))
    at = {"low": low, "high": high, "mid": middle, "y0": top, "y1": bottom}
    return pages.select(*keys, F.expr(_up(at)).cast("int").alias("up"), F.expr(_down(at)).cast("int").alias("down"))


def _boxes() -> Column:
    return F.collect_list(F.struct(*SIDES))


def _meeting(at: dict) -> str:
    return f"filter(boxes, b -> not (b.right < {at['low']} or b.left > {at['high']}))"


def _covered(at: dict) -> str:
    return f"exists({_meeting(at)}, b -> b.bottom >= {at['mid']} and b.top <= {at['mid']})"


def _up(at: dict) -> str:
    return f"if({_covered(at)}, {at['mid']}, coalesce(array_max(transform(filter({_meeting(at)}, b -> b.bottom < {at['mid']}), b -> b.bottom)), {at['y0']}))"


def _down(at: dict) -> str:
    return f"if({_covered(at)}, {at['mid']}, coalesce(array_min(transform(filter({_meeting(at)}, b -> b.top > {at['mid']}), b -> b.top)), {at['y1']}))"


def layout_of_pages(elements: DataFrame, keys: list[str], width: int, height: int, slice_width: int = 20, border: float = 0.15) -> DataFrame:
    """Zones of each page: (keys, layout, seq, zone, left, top, right, bottom), by a cascade over the middle slice.

    1. No box crosses the slice between the top of the highest and the bottom of the lowest box, and both columns hold a box: two columns.
    2. The free part of the slice around its middle row reaches to within ``border`` of both ends: two columns between these rows.
    3. Around the row at a quarter it reaches to within ``border`` of the upper end, and all three zones hold a box: an inverted T,
       columns above a wide zone.
    4. Around the row at three quarters it reaches to within ``border`` of the lower end, and all three zones hold a box: a T, columns
       below a wide zone.
    5. Else the whole page is one zone.

    A box is held by a zone if it lies wholly inside it.  Pages are known by their boxes; the slice is free where none meets it.
    """
    low, high = width // 2 - slice_width // 2, width // 2 + slice_width // 2

    def zone(name: str, left: object, top: str, right: object, bottom: str) -> str:
        values = ", ".join(f"cast({v} as int) as {n}" for n, v in zip(SIDES, (left, top, right, bottom), strict=True))
        return f"struct('{name}' as zone, {values})"

    def columns(names: tuple[str, str], top: str, bottom: str) -> list[str]:
        return [zone(names[0], 0, top, low, bottom), zone(names[1], high, top, width, bottom)]

    def probe(share: str) -> dict[str, str]:
        at = {"low": low, "high": high, "mid": share, "y0": "y0", "y1": "y1"}
        return {"up": _up(at), "down": _down(at)}

    pages = elements.groupBy(*keys).agg(_boxes().alias("boxes"), F.min("top").alias("y0"), F.max("bottom").alias("y1"))
    rows_ = {"half": "(y0 + y1) div 2", "quarter": "cast(y0 + (y1 - y0) * 0.25D as int)", "three": "cast(y0 + (y1 - y0) * 0.75D as int)"}
    for name, row in rows_.items():
        pages = pages.withColumn(name, F.expr(f"if({row} = 0, (y0 + y1) div 2, {row})"))
    for name in rows_:
        pages = pages.withColumns({f"{name}_{side}": F.expr(sql) for side, sql in probe(name).items()})
    zones = {
        "TWO_COLUMN": columns(("LEFT", "RIGHT"), "y0", "y1"),
        "TWO_COLUMN_BORDER": columns(("LEFT", "RIGHT"), "half_up", "half_down"),
        "INVERTED_T": [*columns(("LEFT_UP", "RIGHT_UP"), "quarter_up", "quarter_down"), zone("LOW", 0, "quarter_down", width, str(height))],
        "T": [zone("UP", 0, "0", width, "three_up"), *columns(("LEFT_LOW", "RIGHT_LOW"), "three_up", "three_down")],
        "DEFAULT": [zone("DEFAULT", 0, "0", width, str(height))],
    }
    held = "forall(array({}), z -> exists(boxes, b -> b.left >= z.left and b.right <= z.right and b.top >= z.top and b.bottom <= z.bottom))"
    upper, lower = f"{{}}_up <= y0 + (y1 - y0) * {border}D", f"{{}}_down >= y1 - (y1 - y0) * {border}D"
    tests = {
        "TWO_COLUMN": f"not exists(boxes, b -> b.left < {high} and b.right > {low}) and {held.format(', '.join(zones['TWO_COLUMN']))}",
        "TWO_COLUMN_BORDER": f"{upper.format('half')} and {lower.format('half')}",
        "INVERTED_T": f"{upper.format('quarter')} and {held.format(', '.join(zones['INVERTED_T']))}",
        "T": f"{lower.format('three')} and {held.format(', '.join(zones['T']))}",
        "DEFAULT": "true",
    }
    chosen = "case " + " ".join(f"when {test} then struct('{name}' as layout, array({', '.join(zones[name])}) as zones)" for name, test in tests.items()) + " end"
    found = pages.select(*keys, F.expr(chosen).alias("found"))
    return found.select(*keys, "found.layout", F.posexplode("found.zones").alias("seq", "z")).select(*keys, "layout", "seq", "z.*")


def zone_paragraphs(elements: DataFrame, keys: list[str], width: int, height: int, order: str = "index") -> DataFrame:
    """Per zone its paragraphs in order and its last fragment; ``elements`` has keys, zone, order, text, kind and the box.

    Junk is left out.  The last element in order is carried on if it is also the last by place (in a page that is one zone
    the one nearest to the lower right corner, else the lowest; the first of equals), a Text, and no finished sentence.  Of the
    others, text chunks are paragraphs; words split by hyphens are joined.  Wide zones above or below columns yield nulls.
    """
    kept = elements.where(~T.is_junk("text", "kind"))
    far = F.when(F.col("zone") == "DEFAULT", -(F.pow(F.col("right") - width, 2) + F.pow(F.col("bottom") - height, 2))).otherwise(F.col("bottom").cast("double"))
    item = F.struct(F.col(order).alias("at"), "text", "kind", far.alias("far"), T.is_text_chunk("text", "kind").alias("chunk"))
    zones = elements.select(*keys, "zone").distinct()
    grouped = kept.groupBy(*keys, "zone").agg(F.sort_array(F.collect_list(item)).alias("x"))
    farthest = F.array_max(F.transform("x", lambda e: e["far"]))
    last = F.element_at("x", -1)
    first_far = F.array_min(F.transform(F.filter("x", lambda e: e["far"] == farthest), lambda e: e["at"]))
    carried = (first_far == last["at"]) & (last["kind"] == "Text") & ~last["text"].endswith(".")
    rest = F.when(carried, F.slice("x", 1, F.size("x") - 1)).otherwise(F.col("x"))
    paragraphs = F.transform(F.filter(rest, lambda e: e["chunk"]), lambda e: T.dehyphenated(e["text"]))
    wide = F.col("zone").isin("UP", "LOW")
    empty = F.array().cast("array<string>")
    return zones.join(grouped, [*keys, "zone"], "left").select(
        *keys, "zone", F.when(~wide, F.when(F.col("x").isNull(), empty).otherwise(paragraphs)).alias("paragraphs"), F.when(~wide & carried, T.dehyphenated(last["text"])).alias("last_fragment")
    )


def postprocessed(elements: DataFrame, zones: DataFrame, doc: str, width: int, height: int, tolerance: int = 10) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of each zone and references of each document.

    ``elements`` has doc, page, index (in the document), kind, text and the box; ``zones`` has doc, page, seq, zone and its box.
    Elements are taken zone by zone, page by page.  What follows the reference title, up to the next section header, are
    references; after that header nothing is read, nor are paragraphs of the zone in which references begin and end.

    Returns (doc, page, seq, zone, paragraphs, last_fragment) and (doc, references).
    """
    place = F.struct("page", "seq", "index")
    inside = contained(elements, zones, [doc, "page"], tolerance, ["seq"]).withColumn("place", place)
    titles = reference_title(elements, [doc]).where("place >= 0").select(doc, F.col("place").alias("title"))
    start = inside.join(titles, doc).where("index = title").groupBy(doc).agg(F.min("place").alias("start"))
    headers = inside.join(start, doc).where((F.col("place") > F.col("start")) & (F.col("kind") == "Section header"))
    limits = start.join(headers.groupBy(doc).agg(F.min("place").alias("stop")), doc, "left")
    marked = inside.join(limits, doc, "left")
    ended_there = (F.col("stop.page") == F.col("start.page")) & (F.col("stop.seq") == F.col("start.seq"))
    in_zone = (F.col("page") == F.col("start.page")) & (F.col("seq") == F.col("start.seq"))
    article = F.col("start").isNull() | (F.col("place") < F.col("start")) & ~F.coalesce(ended_there & in_zone, F.lit(False))
    reference = (F.col("place") > F.col("start")) & (F.col("stop").isNull() | (F.col("place") < F.col("stop"))) & ~T.is_junk("text", "kind")
    paragraphs = zone_paragraphs(marked.where(article).drop("start", "stop"), [doc, "page", "seq"], width, height)
    references = marked.where(reference).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("place", T.dehyphenated("text").alias("text")))).alias("x"))
    return paragraphs, references.select(doc, F.transform("x", lambda x: x["text"]).alias("references"))


def reference_title(elements: DataFrame, keys: list[str], order: str = "index") -> DataFrame:
    """Per document the place of the one header REFERENCE LIST, else of the one header REFERENCES, else -1."""
    title = F.upper("text")
    header = F.col("kind") == "Section header"
    counted = elements.groupBy(*keys).agg(
        F.count_if(header & (title == "REFERENCE LIST")).alias("n_list"),
        F.min(F.when(header & (title == "REFERENCE LIST"), F.col(order))).alias("at_list"),
        F.count_if(header & (title == "REFERENCES")).alias("n_plain"),
        F.min(F.when(header & (title == "REFERENCES"), F.col(order))).alias("at_plain"),
    )
    place = F.when(F.col("n_list") == 1, F.col("at_list")).when(F.col("n_plain") == 1, F.col("at_plain")).otherwise(-1)
    return counted.select(*keys, place.alias("place"))

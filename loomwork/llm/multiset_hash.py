"""Homomorphic multiset hash of a text's paragraphs, with SQL functions only.

The paragraphs (lines with a character that is not white space) form a multiset.  Each is hashed with SHA-512 to 16
wide lanes of 32 bits; a text's fingerprint holds the sums of the lanes modulo 2^32, so it does not depend on order,
and paragraphs can be added or taken away without the text (``combined``).  Beside these dense lanes stand 64 sparse
lanes of 16 bits: a paragraph is added, modulo 2^16, to one lane that its hash names.  Lanes that no differing paragraph
touches agree, which gives a likeness from fingerprints alone.

A fingerprint is a string of hexadecimal digits: number of paragraphs (8), dense lanes (128), sparse lanes (256).

The next document in the order of ids is found without a global sort: boundaries from an approximate percentile, one
per shuffle partition, divide the ids into ranges; each range is ordered by itself, and the first document of every
range is also given to the range before it.

Defined results: a null text is empty; empty texts have the fingerprint of the empty multiset, all zeros; ids that are
null come first; rows that share an id are ordered by text; the only document follows itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE, SPARSE = 16, 64


def fingerprint(text: str) -> Column:
    """Fingerprint of the SQL expression ``text``."""
    number = "cast(conv({}, 16, 10) as bigint)"
    dense = f"lpad(lower(hex(aggregate(hs, 0L, (a, h) -> a + {number.format('substring(h, i * 8 + 1, 8)')}) % 4294967296L)), 8, '0')"
    lanes = f"transform(hs, h -> struct({number.format('substring(h, 1, 2)')} % {SPARSE} as lane, {number.format('substring(h, 3, 4)')} as value))"
    sparse = "lpad(lower(hex(aggregate(vs, 0L, (a, v) -> a + if(v.lane = i, v.value, 0L)) % 65536L)), 4, '0')"
    return F.expr(f"""
        transform(array(transform(filter(split({text}, '\\n'), p -> p rlike '\\\\S'), p -> sha2(p, 512))), hs -> concat(
            lpad(lower(hex(size(hs))), 8, '0'),
            array_join(transform(sequence(0, {DENSE - 1}), i -> {dense}), ''),
            transform(array({lanes}), vs -> array_join(transform(sequence(0, {SPARSE - 1}), i -> {sparse}), ''))[0]
        ))[0]""")


def combined(one: str, two: str, sign: int = 1) -> Column:
    """Fingerprint of the sum (or, with sign -1, difference) of two multisets, from their fingerprints."""
    lane = "cast(conv(substring({}, {}, {}), 16, 10) as bigint)"

    def lanes(start: str, width: int, modulus: int) -> str:
        a, b = (lane.format(x, start, width) for x in (one, two))
        return f"lpad(lower(hex(pmod({a} + {sign} * {b}, {modulus}L))), {width}, '0')"

    return F.expr(f"""concat({lanes('1', 8, 2**32)},
        array_join(transform(sequence(0, {DENSE - 1}), i -> {lanes('9 + i * 8', 8, 2**32)}), ''),
        array_join(transform(sequence(0, {SPARSE - 1}), i -> {lanes(f'{9 + DENSE * 8} + i * 4', 4, 2**16)}), ''))""")


def likeness(one: str, two: str) -> Column:
    """Estimated share of common paragraphs, from two fingerprints: 1 if they are equal.

    Of the occupied sparse lanes a share r agrees; a lane that holds m paragraphs agrees if all of them are common, so
    the share of common paragraphs is about r^(1/m).
    """
    at = f"{9 + DENSE * 8} + i * 4"
    lane = f"(substring({one}, {at}, 4), substring({two}, {at}, 4))"
    pairs = f"filter(transform(sequence(0, {SPARSE - 1}), i -> struct{lane}), p -> p.col1 <> '0000' or p.col2 <> '0000')"
    count = " + ".join(f"cast(conv(substring({x}, 1, 8), 16, 10) as bigint)" for x in (one, two))
    return F.expr(f"""
        case when {one} = {two} then 1.0D else coalesce(transform(array({pairs}), ps ->
            power(try_divide(size(filter(ps, p -> p.col1 = p.col2)), size(ps)), try_divide(1.0D, greatest(1.0D, try_divide({count}, 2.0D * size(ps))))))[0], 0.0D) end""").cast("double")


def _long(x: int | None) -> str:
    return "bigint(null)" if x is None else f"bigint('{x}')"


def _range_of(order: str, limits: list[int]) -> Column:
    """Number of limits up to the value, found in two steps: among every ``step``-th of them, then between two of these."""
    if not limits:
        return F.lit(0)
    step = max(1, int(len(limits) ** 0.5))
    value = f"`{order}`"
    coarse = f"array({', '.join(_long(x) for x in limits[step - 1 :: step])})" if len(limits) >= step else "cast(array() as array<bigint>)"
    parts = ", ".join(f"array({', '.join(_long(x) for x in limits[a : a + step])})" for a in range(0, len(limits), step))
    return F.expr(f"""coalesce(element_at(transform(array(size(filter({coarse}, b -> b <= {value}))),
        k -> k * {step} + coalesce(size(filter(try_element_at(array({parts}), k + 1), b -> b <= {value})), 0)), 1), 0)""").cast("int")


def with_next(docs: DataFrame, columns: dict[str, str], order: str = "doc_id", tie: str = "text") -> DataFrame:
    """Adds to each row values of the row that follows it by (order, tie); the first follows the last.

    ``columns`` maps new names to columns of the following row.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = [k / ranges for k in range(1, ranges)] or [0.5]
    limits = sorted(set(docs.agg(F.percentile_approx(order, points, max(10000, 10 * ranges)).alias("p")).first().p or []))
    place = _range_of(order, limits).alias("range")
    ranged = docs.select("*", place)
    # of each range the first id: as many rows as there are ranges
    firsts = {r["range"]: r.first for r in docs.select(place, order).groupBy("range").agg(F.min(F.struct(F.col(order).isNotNull().alias("known"), order))[order].alias("first")).collect()}
    used = sorted(firsts)
    before = {firsts[k]: used[i - 1] for i, k in enumerate(used)}  # the first of all goes to the last range
    values = ", ".join(f"({_long(x)}, {k})" for x, k in before.items()) or "(bigint(null), 0)"
    targets = spark.sql(f"SELECT a AS _first, b AS range FROM VALUES {values} AS t(a, b)")  # a row a range
    heads = docs.join(F.broadcast(targets), F.col(order).eqNullSafe(F.col("_first"))).drop("_first")
    first_row = Window.partitionBy(order).orderBy(F.col(tie).asc_nulls_first())
    heads = heads.withColumn("_k", F.row_number().over(first_row)).where("_k = 1").drop("_k")
    both = ranged.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)))
    ahead = Window.partitionBy("range").orderBy("_head", F.col(order).asc_nulls_first(), F.col(tie).asc_nulls_first())
    return both.select("*", *[F.lead(c).over(ahead).alias(n) for n, c in columns.items()]).where("_head = 0").drop("_head", "range")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of texts whose last half is replaced by the start of the next document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.withColumn("fingerprint", fingerprint("text"))
    return (
        with_next(own, {"next_text": "text", "next_fingerprint": "fingerprint"})
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, n_chars div 2))"))
        .withColumn("edited_fingerprint", fingerprint("edited"))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
            likeness("fingerprint", "next_fingerprint").alias("near_next"),
        )
    )

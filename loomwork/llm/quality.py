"""Quality rules as a short-circuit cascade, with SQL functions only.

A rule is a SQL predicate that says whether a document fails; it is written over the measures of a text, such as
``{n_words}``, its words ``{w}`` and the text ``{t}``.  On a sample of about ``sample_rows`` rows, drawn by hash from the whole table
(a documented parameter), each rule is timed and the share of rows it rejects is counted; rules are then ordered by
rejection per cost and evaluated in one CASE, so that a document is dropped by the cheapest rule that can drop it and
later rules are not evaluated.  ``keep_documents`` computes nothing that no evaluated rule asks for.  ``judge_documents`` returns the
measures, so it computes each once and runs the cascade over their columns; only rules that look at words themselves
are left to be short-circuited there.  A document is kept if no rule rejects it, so the order decides the cost, never the result.

Three-word windows are compared by 64-bit hashes: in a text of ``n`` words the odds of a wrong count are below ``n * n / 2 ** 65``.

Defined results: a null text has no words and fails; null ids are kept as they are; repeated rows are judged each; very long texts
are judged whole, in n log n; an empty table gives an empty result; other columns are kept by ``keep_documents`` and ignored by
``judge_documents``.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "\\\\x20\\\\x09-\\\\x0D"
SYMBOLS = "#*$%&|<>"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: The words of {t}: what stands between blanks at its ends is split off before.
WORDS = f"filter(split({{t}}, '[{BLANK}]+'), x -> x <> '')"
LINES = f"filter(split({{t}}, '\\n'), l -> l rlike '[^{BLANK}]')"


def _repeated_words() -> str:
    """Number of words in 3-word windows that stand twice or more in the text.

    Most texts have no such window, which the number of distinct hashes shows.  Else the hashes are sorted with their
    places, equal neighbours give the repeated places, and the words these cover are counted.
    """
    hashes = "transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
    pairs = "sort_array(transform(hs, (h, i) -> struct(h, i)))"
    places = "flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))"
    covered = f"size(array_distinct(flatten(transform({places}, p -> array(p, p + 1, p + 2)))))"
    counted = _let(hashes, "hs", f"if(size(array_distinct(hs)) = size(hs), 0, {_let(pairs, 's', covered)})")
    return f"if(size({{w}}) < 4, 0, {counted})"


#: Measures of a text {t} with the words {w}, as SQL.
MEASURES = {
    "n_words": "size({w})",
    "word_chars": "length(translate({t}, ' \\t\\n\\u000B\\u000C\\r', ''))",
    "n_symbols": f"length({{t}}) - length(translate({{t}}, '{SYMBOLS}', ''))",
    "n_lines": f"size({LINES})",
    "n_dup_lines": f"if(instr({{t}}, '\\n') = 0, 0, {_let(LINES, 'ls', 'size(ls) - size(array_distinct(ls))')})",
    "n_repeat_words": _repeated_words(),
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule: documents for which ``rejects`` holds fail it."""

    name: str
    rejects: str

    def over_text(self, t: str, w: str) -> str:
        """The rule as SQL over a text and its words."""
        sql = self.rejects
        for name, measure in MEASURES.items():
            sql = sql.replace(f"{{{name}}}", f"({measure})")
        return sql.replace("{t}", t).replace("{w}", w)

    def over_measures(self, t: str, w: str) -> str:
        """The rule as SQL over columns that have the measures' names."""
        return re.sub(r"\{(\w{2,})\}", r"\1", self.rejects).replace("{t}", t).replace("{w}", w)


BASE_RULES = (
    Rule("too_few_words", "{n_words} < 50"),
    Rule("repeated_windows", "100 * {n_repeat_words} > 50 * {n_words}"),
)
METHOD_RULES = (
    Rule("symbols", "100 * {n_symbols} > 5 * {word_chars}"),
    Rule("repeated_lines", "2 * {n_dup_lines} > {n_lines}"),
    Rule("capitals", "2 * size(filter({w}, x -> length(x) > 1 and x = upper(x) and x <> lower(x))) > {n_words}"),
    Rule("no_letters", "2 * size(filter({w}, x -> not x rlike '\\\\p{L}')) > {n_words}"),
    Rule("word_length", "{word_chars} > 100 * {n_words}"),
)
RULES = BASE_RULES + METHOD_RULES


def _verdict(rules: list[Rule] | tuple[Rule, ...], t: str) -> str:
    """Whether a text is kept: the words are split once, the rules evaluated until one rejects."""
    return _let(WORDS.replace("{t}", t), "w", "case " + " ".join(f"when {r.over_text(t, 'w')} then false" for r in rules) + " else true end")


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of the whole table, chosen by the hash of id and text, and twice as many at most."""
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * rows)


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejection per cost on a sample; ties keep the given order."""
    texts = [r.text for r in sampled(docs.select("doc_id", "text"), sample_rows).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).collect()]
    if not texts:
        return list(rules)
    sample = docs.sparkSession.createDataFrame([(t,) for t in texts], "text string").coalesce(1)

    def seconds(condition: str) -> tuple[float, int]:
        began = time.perf_counter()
        n = sample.agg(F.count_if(F.expr(condition)).alias("n")).first().n
        return time.perf_counter() - began, n

    seconds("length(text) > 0")
    idle = seconds("length(text) > 0")[0]
    worth = {}
    for r in rules:
        took, kept = seconds(_verdict([r], "text"))
        worth[r.name] = (1 - kept / len(texts)) / max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: -worth[r.name])


def judge_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Per document: the base measures, whether a base rule fails, and the verdict of the cascade."""
    order = ordered_rules(docs, rules, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = texts.withColumn("w", F.expr(WORDS.replace("{t}", "t")))
    measured = split.select("doc_id", "t", "w", *[F.expr(sql.replace("{t}", "t").replace("{w}", "w")).cast("long").alias(m) for m, sql in MEASURES.items()])
    base = " or ".join(r.over_measures("t", "w") for r in BASE_RULES)
    verdict = "case " + " ".join(f"when {r.over_measures('t', 'w')} then false" for r in order) + " else true end"
    return measured.select("doc_id", *BASE_MEASURES, F.expr(base).alias("base_failed"), F.expr(verdict).alias("kept"))


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = ordered_rules(docs, rules, sample_rows)
    whole = docs.withColumn("_whole_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return whole.where(F.expr(_verdict(order, "_whole_text"))).drop("_whole_text")

"""Text functions as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own, by which both tokenizers filter.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so that the their them then there these they this to was we were what when "
    "which who will with you your"
).split()


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dehyphenated(t: str | Column) -> Column:
    """Joins words split by a hyphen and a space; letters of all scripts count."""
    return F.regexp_replace(col(t), r"(?U)(\w+)- (\w+)", "$1$2")


def single_space_words(t: str | Column) -> Column:
    """Number of parts between single spaces; empty parts count."""
    return F.size(F.split(col(t), " "))


def is_box_header(t: str | Column, section_header: Column | None = None) -> Column:
    """Starts with BOX in any case, and is a section header or has a number and a bar."""
    upper = F.upper(col(t))
    numbered = upper.rlike(r"(?U)^BOX \w?-?\d+") & col(t).contains("|")
    return upper.startswith("BOX") & (numbered if section_header is None else numbered | section_header)


def is_sentence_end(t: str | Column) -> Column:
    return col(t).endswith(".")


def is_picture_or_table(t: str | Column, kind: str | Column) -> Column:
    """Pictures, tables and what belongs to them: sources of fewer than ten words, notes, captions, numbered titles with a bar."""
    upper, words = F.upper(col(t)), single_space_words(t)
    source = (upper.startswith("SOURCE:") | upper.startswith("SOURCES:")) & (words < 10)
    note = upper.startswith("NOTE:") | upper.startswith("NOTES:") | upper.startswith("ABBREVIATIONS:") | upper.startswith("NOTES AND SOURCES:")
    caption = (upper.startswith("FIGURE") | upper.startswith("TABLE")) & (col(kind) == "Caption")
    numbered = upper.rlike(r"(?U)^(FIGURE|TABLE) \w?-?\d+") & col(t).contains("|")
    return col(kind).isin("Picture", "Table") | source | note | caption | numbered


def is_junk(t: str | Column, kind: str | Column) -> Column:
    """Elements that are no running text: pictures and tables, page headers and footers, scraps."""
    scrap = (F.length(col(t)) < 4) | col(t).startswith("Suggested Citation:")
    return is_picture_or_table(t, kind) | col(kind).isin("Page header", "Page footer") | scrap


def is_text_chunk(t: str | Column, kind: str | Column) -> Column:
    """More than seven words, or a box header, or a list item."""
    return (single_space_words(t) > 7) | is_box_header(t, col(kind) == "Section header") | (col(kind) == "List item")


def normalized_term(t: str | Column) -> Column:
    """Lower case, only a-z, 0-9, white space and hyphens, single spaces, no trailing s of longer terms."""
    x = F.regexp_replace(F.trim(F.lower(col(t))), r"[^a-z0-9\s-]", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(x) > 7, F.regexp_replace(x, "s+$", "")).otherwise(x)


def alnum_key(t: str | Column) -> Column:
    return F.regexp_replace(col(t), r"(?U)[^\p{Alnum}]", "")


def safe_name(t: str | Column) -> Column:
    return F.regexp_replace(col(t), r'[\\/:*?"<>|]', "_")


def path_name(t: str | Column) -> Column:
    return F.regexp_replace(col(t), r"\W+", "_")


def tokens_letters(t: str | Column) -> Column:
    """Tokenizer A: runs of letters in lower case that are no stop words."""
    found = F.regexp_extract_all(F.lower(col(t)), F.lit(r"\p{L}+"), 0)
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def tokens_alnum(t: str | Column) -> Column:
    """Tokenizer B: alphanumeric parts between white space whose original case is no stop word, then in lower case."""
    parts = F.split(F.trim(col(t)), r"\s+")
    return F.transform(F.filter(parts, lambda w: w.rlike(r"(?U)^\p{Alnum}+$") & ~w.isin(*STOPWORDS)), lambda w: F.lower(w))


def chunks(t: str | Column, size: int, overlap: int) -> Column:
    """Array of (seq, text): windows of ``size`` words between white space that share ``overlap`` words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    words = F.filter(F.split(col(t), r"\s+"), lambda w: w != "")
    # the words are bound once; the last window is the one that reaches the end
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int"))),
        lambda k: F.struct(k.alias("seq"), F.array_join(F.slice(w, k * step + 1, F.lit(size)), " ").alias("text")),
    )
    return F.filter(F.get(F.transform(F.array(words), cut), F.lit(0)), lambda c: c["text"] != "")


def hop_parts(t: str | Column) -> Column:
    """Parts between hop marks ``<n-hop>``."""
    return F.filter(F.split(col(t), r"<\d+-hop>\s*"), lambda p: p != "")


def with_hop_marks(texts: str | Column) -> Column:
    return F.transform(col(texts), lambda t, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit("-hop>\n\n"), t))


def clean_question(t: str | Column) -> Column:
    """Without a leading number."""
    return F.trim(F.regexp_replace(F.trim(col(t)), r"^\d+[\).\s]", ""))


def split_list(t: str | Column, separator: str = ";") -> Column:
    """Trimmed non-empty parts."""
    return F.filter(F.transform(F.split(col(t), separator), lambda x: F.trim(x)), lambda x: x != "")


def url_domain(u: str | Column) -> Column:
    return F.split_part(col(u), F.lit("/"), F.lit(3))


def url_tail(u: str | Column) -> Column:
    """Last segment of the path, without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(col(u), r"[?#].*$", ""), "/"), -1)


def first_allowed(value: str | Column, allowed: tuple[str, ...]) -> Column:
    """The first allowed value contained; null if none is."""
    out = F.when(col(value).contains(allowed[0]), F.lit(allowed[0]))
    for a in allowed[1:]:
        out = out.when(col(value).contains(a), F.lit(a))
    return out


def joined_url(base: str, path: str | Column) -> Column:
    """A path below a base; an address of its own stays."""
    return F.when(col(path).rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), col(path)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(col(path), F.lit("/"))))


def last_segments(u: str | Column, n: int) -> Column:
    """The last ``n`` segments of a path, joined by slashes."""
    parts = F.split(F.rtrim(col(u), F.lit("/")), "/")
    return F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), F.lit(n)), "/")


def levenshtein_ratio(a: str | Column, b: str | Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(col(a), col(b)) / longer)


def hamming_ratio(a: str | Column, b: str | Column) -> Column:
    """Share of equal characters at equal places of the longer text; 1 for two empty texts."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    equal = F.size(F.filter(F.arrays_zip(F.split(col(a), "").alias("x"), F.split(col(b), "").alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(longer == 0, 1.0).otherwise(equal / longer)

"""Main-text extraction with templates deduced from equivalence classes of tokens.

*Tokens.*  A page's tokens are its elements, named by a digest of the path of element names and class words from the root, and its
blocks of text at their elements.  A token's occurrence vector says how often it stands in each page of its host; tokens
with equal vectors form an equivalence class.

*Template.*  Elements that stand once in each page of their class, in classes that half of the host's pages have, are nested below
each other by their paths: the template.  What varies between its elements are slots.

*Slots.*  Each element of the template has the weight of the text that stands in it over all pages, without links and without text
that every page repeats.  Menus, forms and the like have none, by their names or, for the template's elements that
are mere containers, by their class words.  From the root the search goes down to the element that holds most of the weight, as
long as no heading is left behind; an element called article or main is preferred, if a good share of the weight is in it, and ends the
search.  This container is the article's slot, and its blocks are the text: without repeated text, unless that is most
of what the slot holds (then the host's pages are copies of one article).

Class words inside a slot decide nothing, so ``<p class="related-work">`` in an article stays.  A page that has no element
of its host's container is its own host.

Occurrence vectors are compared by digests: sums, over the pages, of hashes of page and count.  They are summed by host
and token before the shuffle; what then goes to one task is what half of a host's pages have, a page or two
in size.  Pages are joined with the templates' table, which leaves a host with very many pages free to be split.

Pages are read in linear time: a tag whose quotes never close ends at its first ``>``, as do all later ones; markup without any
``>`` after it is text.

Defined results: null html is empty and gives an empty text; null urls have one host, ''; repeated rows are extracted
each; very long pages are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import in_small_batches, rows
from loomwork.llm.scratch import written

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("head nav footer aside form button select menu dialog object canvas audio video".split()) | RAW
CLOSED_BY = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
ENDS_PARAGRAPH = BLOCK - {"html", "head", "body"}
BARRIER = frozenset("table ul ol dl article main section div body nav aside footer header form".split())
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice "
    "notices popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINER = frozenset("body div section article main table tbody tr td center ul ol dl details fieldset figure".split())
HEADING = frozenset({"h1", "h2", "h3"})

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - 2**63


ROOT = _digest("root")


@dataclass(frozen=True, slots=True)
class Element:
    """An open element: its path's digest and that of the element above, its name, and whether class words mark it."""

    token: int
    parent: int
    name: str
    marked: bool
    main: bool


TOP = Element(ROOT, 0, "", False, False)


class Scanner:
    """The tags of a page, in linear time."""

    def __init__(self, text: str):
        self.text, self.last, self.quotes = text, text.rfind(">"), True

    def _end(self, at: int) -> int:
        """Where the tag that has its attributes from ``at`` ends."""
        first = self.text.find(">", at)
        if not self.quotes:
            return first
        while (m := _STOP.search(self.text, at)) and m[0] != ">":
            at = self.text.find(m[0], m.end()) + 1
            if not at:
                break
        else:
            if m:
                return m.start()
        self.quotes = False
        return first

    def tags(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, slash, name, attributes); comments and declarations have no name, raw elements are one tag."""
        text, at = self.text, 0
        while (start := text.find("<", at)) >= 0:
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                at = len(text) if end < 0 else end + 3
                yield start, at, "", "", ""
                continue
            if start > self.last:
                return
            m = _NAME.match(text, start)
            if m:
                end = self._end(m.end())
                at = end + 1
                yield start, at, m[1], m[2].lower(), text[m.end() : end]
            elif text.startswith(("<!", "<?"), start):
                at = text.find(">", start) + 1
                yield start, at, "", "", ""
            else:
                at = start + 1

    def after(self, name: str, at: int) -> int:
        """Where the content of a raw element ends."""
        m = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(self.text, at)
        return m.end() if m else len(self.text)


State = object


def blocks(text: str, opened: Callable[[State, Element], State], top: State) -> Iterator[tuple[State, str, int]]:
    """The blocks of a page in order: the state of the element that they stand in, their text, and how much of it is in links.

    ``opened`` gives the state of an element from that of the element above it; elements outside of any article are left out.
    """
    stack: list[tuple[str, Element, State, bool]] = [("", TOP, top, False)]  # name, element, state, outside
    count: dict[str, int] = {}
    held: list[str] = []
    links = 0
    scanner = Scanner(text)

    def cut(k: int) -> None:
        for x in stack[k:]:
            count[x[0]] -= 1
        del stack[k:]

    def close(names: frozenset[str] | set[str]) -> None:
        """Closes the innermost open element of the names, unless a barrier stands between."""
        if any(count.get(n) for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    cut(k)
                    return
                if stack[k][0] in BARRIER:
                    return

    def flush() -> Iterator[tuple[State, str, int]]:
        nonlocal links
        if held:
            words = entities.unescape("".join(held)).split()
            held.clear()
            if words and not stack[-1][3]:
                yield stack[-1][2], " ".join(words), links
        links = 0

    at = 0
    for start, end, slash, name, attributes in scanner.tags():
        if start < at:
            continue
        if start > at:
            held.append(text[at:start])
            if count.get("a"):
                links += start - at
        at = end
        if not name:
            continue
        if name == "br":
            held.append(" ")
        elif name in BLOCK:
            yield from flush()
        if slash:
            if count.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if stack[k][3]:
                            yield from flush()
                        cut(k)
                        break
                    if name == "p" and stack[k][0] in BARRIER:
                        break
            continue
        if name in VOID:
            continue
        if name in ENDS_PARAGRAPH:
            close({"p"})
        if name in CLOSED_BY:
            close(CLOSED_BY[name])
        _, above, state, outside = stack[-1]
        words = set(_WORDS.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower())) if attributes else set()
        now_outside = outside or name in OUTSIDE or name == "header" and not (count.get("article") or count.get("main"))
        if now_outside and not outside:
            yield from flush()
        if name in RAW:
            at = scanner.after(name, end)
            continue
        element = above
        if name not in INLINE and not now_outside:
            label = f"{name}.{'.'.join(sorted(words))}" if words else name
            marked = name in CONTAINER - {"body", "article", "main"} and bool(words & NO_ARTICLE)
            element = Element(_digest(str(above.token), label), above.token, name, marked, name in ("article", "main") or "main" in words and name in CONTAINER)
            state = opened(state, element)
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, element, state, now_outside))
            count[name] = count.get(name, 0) + 1
    held.append(text[at:])
    yield from flush()


@dataclass
class Token:
    """A token of a page, or of all pages of a host that have it."""

    token: int
    parent: int
    name: str = ""
    marked: bool = False
    main: bool = False
    is_text: bool = False
    times: int = 0
    chars: int = 0
    pages: int = 1
    one: int = 0
    two: int = 0


def page_tokens(text: str) -> dict[int, Token]:
    """The tokens of a page: its root, its elements and its blocks, with their numbers and what text stands in them."""
    found = {ROOT: Token(ROOT, 0, times=1)}

    def opened(_: State, e: Element) -> Element:
        own = found.setdefault(e.token, Token(e.token, e.parent, e.name, e.marked, e.main))
        own.times += 1
        return e

    for e, words, links in blocks(text, opened, TOP):
        found[e.token].chars += max(0, len(words) - links)
        own = found.setdefault(text_token(e.token, words), Token(text_token(e.token, words), e.token, is_text=True))
        own.times += 1
        own.chars += max(0, len(words) - links)
    return found


def text_token(element: int, words: str) -> int:
    return _digest("text", str(element), words)


@dataclass(frozen=True)
class Template:
    """What extraction needs to know of a host: the article's slot, containers that are none of it, and repeated texts."""

    container: int
    excluded: frozenset[int] = field(default_factory=frozenset)
    texts: frozenset[int] = field(default_factory=frozenset)


def host_of(url: str) -> str:
    """SQL for the host of a URL; '' where there is none."""
    return f"coalesce(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '')"


def deduced_template(tokens: list[Token], of_host: int, repeats: bool) -> Template:
    """The template of a host from the tokens that half of its pages have.  ``repeats``: whether it has enough different
    pages to tell that a text repeats."""
    elements = {t.token: t for t in tokens if not t.is_text}
    common = {k for k, t in elements.items() if 2 * t.pages >= of_host}
    classes: dict[tuple[int, int], set[int]] = {}
    for k in common:
        if elements[k].times == elements[k].pages:
            classes.setdefault((elements[k].one, elements[k].two), set()).add(k)
    frame = set().union(*classes.values())
    excluded = {k for k in common if elements[k].marked}

    below: dict[int, list[int]] = {}
    for k in common:
        below.setdefault(elements[k].parent, []).append(k)

    def repeated_below(k: int) -> list[Token]:
        """The texts under an element that are in a class with elements of the template."""
        inside, todo = set(), [k]
        while todo:
            x = todo.pop()
            inside.add(x)
            todo += [y for y in below.get(x, ()) if y not in excluded]
        return [t for t in tokens if t.is_text and t.parent in inside and (t.one, t.two) in classes]

    repeated: dict[int, int] = {}
    if repeats and ROOT in elements:
        for t in repeated_below(ROOT):
            repeated[t.parent] = repeated.get(t.parent, 0) + t.chars

    weight: dict[int, int] = {}
    mains: dict[int, tuple[int, int]] = {}  # the heaviest article or main of the template at or below an element
    order, todo = [], [ROOT]
    while todo:
        k = todo.pop()
        order.append(k)
        todo += [x for x in below.get(k, ()) if x not in excluded]
    for k in reversed(order):
        own = elements[k].chars - repeated.get(k, 0) if k in elements else 0
        weight[k] = max(0, own) + sum(weight.get(x, 0) for x in below.get(k, ()))
        held = [mains[x] for x in below.get(k, ()) if x in frame and x in mains]
        if k in elements and elements[k].main and weight[k]:
            held.append((weight[k], -k))
        if held:
            mains[k] = max(held)
    if repeats and not weight.get(ROOT):  # all pages are copies of one
        return deduced_template(tokens, of_host, False)

    at = ROOT
    while not (at in elements and elements[at].main):
        inner = [x for x in below.get(at, ()) if x in frame and x not in excluded and (elements[x].name in CONTAINER or elements[x].name in ("html", "body"))]
        named = max((mains[x] for x in inner if x in mains), default=(0, 0))
        if named[0] and 10 * named[0] >= 3 * weight[at]:
            at = -named[1]
            continue
        best = max(inner, key=lambda x: (weight[x], -x), default=None)
        left = any(elements[x].name in HEADING and weight[x] for x in below.get(at, ()) if x not in excluded)
        if best is None or left or 10 * weight[best] < 7 * weight[at] or not weight[best]:
            break
        at = best
    texts: list[Token] = []
    if repeats:
        texts = repeated_below(at)
        whole, todo = 0, [at]
        while todo:
            x = todo.pop()
            whole += elements[x].chars
            todo += [y for y in below.get(x, ()) if y not in excluded]
        if 2 * sum(t.chars for t in texts) > whole:
            texts = []
    return Template(at, frozenset(excluded), frozenset(t.token for t in texts))


def extract(text: str, template: Template | None = None) -> str:
    """The main text of a page, given its host's template; without one, or without its container, by its own."""
    if template:
        met = template.container == ROOT

        def opened(state: State, e: Element) -> State:
            nonlocal met
            inside = state[1] or e.token == template.container
            met |= inside
            return e.token, inside, state[2] or e.token in template.excluded

        out = [words for (token, inside, out), words, _ in blocks(text, opened, (ROOT, met, False)) if inside and not out and text_token(token, words) not in template.texts]
        if met:
            return "\n\n".join(out)
    return extract(text, deduced_template(list(page_tokens(text).values()), 1, False))


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _arrow(out: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*out, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


TOKENS = "host string, token long, parent long, name string, marked boolean, main boolean, is_text boolean, times long, chars long, one long, two long"


def templates(pages: DataFrame, least: int = 6) -> DataFrame:
    """(host, container, excluded, texts) of every host; ``pages`` has host, html.  Texts count as repeated in hosts with
    ``least`` different pages or more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for host, text in rows([b], "host", "html"):
                page = xxhash.xxh64_intdigest(text)
                for t in page_tokens(text.decode()).values():
                    weight = xxhash.xxh64_intdigest(b"%d %d" % (page, t.times))
                    out.append((host.decode(), t.token, t.parent, t.name, t.marked, t.main, t.is_text, t.times, t.chars, weight >> 33, weight & 0x7FFFFFFF))
            yield _arrow(out, TOKENS)

    found = pages.select("host", "html").mapInArrow(run, TOKENS)
    keys = ["host", "token", "parent", "name", "marked", "main", "is_text"]
    vectors = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("times", "chars", "one", "two")])
    hosts = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"), F.approx_count_distinct("html").alias("different")), "hosts")
    common = vectors.where(f"not is_text or pages >= {max(2, least // 2)}").join(hosts, "host").where("2 * pages >= of_host")
    wanted = F.struct("token", "parent", "name", "marked", "main", "is_text", "times", "chars", "pages", "one", "two")
    gathered = common.groupBy("host").agg(F.max("of_host").alias("of_host"), F.max("different").alias("different"), F.collect_list(wanted).alias("tokens"))

    def deduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            got = [deduced_template([Token(**t) for t in tokens], n, different >= least) for n, different, tokens in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True)]
            longs = pa.list_(pa.int64())
            arrays = [b.column(0), pa.array([t.container for t in got], pa.int64()), pa.array([sorted(t.excluded) for t in got], longs), pa.array([sorted(t.texts) for t in got], longs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "container", "excluded", "texts"])

    return written(gathered.select("host", "of_host", "different", "tokens").mapInArrow(deduce, "host string, container long, excluded array<long>, texts array<long>"), "templates")


def extract_pages(pages: DataFrame, least: int = 6) -> DataFrame:
    """Per page: page_id, url, text and its code points."""
    source = in_small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("host", F.expr(host_of("url")))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in parts:
            packed = [packer.compress(x) for (x,) in rows([b], "html")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "packed"])

    known = templates(source, least)
    joined = source.mapInArrow(pack, "page_id long, url string, host string, packed binary").join(known, "host", "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for b in parts:
            texts = []
            for packed, container, excluded, repeated in zip(*[b.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True):
                template = None if container is None else Template(container, frozenset(excluded), frozenset(repeated))
                texts.append(extract(unpacker.decompress(packed).decode(), template))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "packed", "container", "excluded", "texts").mapInArrow(run, "page_id long, url string, text string, n_chars long")

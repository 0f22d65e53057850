"""Main-text extraction by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score +1.  Tags score below zero,
by weights learned from labelled pages: those that mark their article with an
<article> or <main> element show how often a tag stands outside it.  One linear
scan finds the contiguous run of the highest score, the content region.  Blocks
of the region are returned, without the elements that are not article text.  Such
an element counts as one tag of a small cost, whatever it holds, so the text on
both its sides stays in one region.

Elements left out wherever they stand: by name (scripts, styles, menus,
headers, footers, sidebars, forms, ...; also the header of an article, headline
and all), by class, id and role (advert, cookie, comments, sidebar, ..., unless
another word of the name points elsewhere), and by learning (containers that the
labelled pages keep outside their article).  A form or block that holds the
article, the main heading or most paragraphs is a container like others.

All pages train the weights: counts per kind of element (name and first class)
are added up on Spark, and every kind gets its weight.  The table of kinds is
broadcast when it is counted and found small; beyond that each page is joined to
the rows of its own kinds, with the same result.

Defined cases: null and empty html give the empty text; a page without any
positive run gives the empty text; of equal regions the first is taken; unclosed
elements end with their parent or at a tag that closes them; an unclosed comment
or script runs to the end; tags are read in one pass, however long the page and
however many of them never close; a broken character reference stays as it is written;
rows are treated one by one, so repeated rows repeat; no rows give no rows.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import join_hot, materialise, store

# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUT = frozenset("head title script style noscript template iframe object svg math canvas audio video nav header footer "
                "aside form button select option textarea label fieldset dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
                  "tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("div section ul ol dl table aside nav header footer form".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar "
                      "navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent notice popup modal overlay newsletter "
                      "subscribe subscription share sharing social comment comments respond replies disqus related recommended "
                      "footer header masthead pagination pager login signup search widget".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

RAW = frozenset("script style noscript template textarea title iframe svg math".split())
#: Words of a class name that say what shape or place an element has, not what it holds.
NEUTRAL = frozenset("area bar block box btn button buttons container content desktop group holder icons inline inner item items left "
                    "links list main mobile outer panel post posts primary right row secondary section site slot small text tools "
                    "top bottom unit wrap wrapper".split())

TAG = re.compile(r"</?[a-z][^\s/>]*+(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>", re.I)
NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
READ = frozenset("class id role hidden aria-hidden".split())
SPLIT = re.compile(r"[^a-z]+")

TEXT_TAGS = frozenset("p a br b i em strong span u s q h1 h2 h3 h4 h5 h6 blockquote code pre sub sup small cite mark abbr time wbr".split())

INSIDE_COST = 0.05  # any tag inside an article
TEXT_COST, UNKNOWN_COST = 0.1, 1.0  # of kinds that the labelled pages do not have
LEFT_OUT_COST = 0.1  # an element left out, outside articles; the tags in it cost nothing
BARRIER = 20.0  # the end of an article, outside articles

BROADCAST_KINDS, BROADCAST_BYTES = 200_000, 16_000_000  # rows and bytes of names of a broadcast table of kinds
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
NAMES = ["page_id", "url", "text", "n_chars"]


@dataclass(frozen=True)
class Weights:
    """Cost of a tag outside articles, and learned kinds of element to leave out."""
    cost: dict = field(default_factory=dict)
    out: frozenset = frozenset()


def tokens(page: str) -> Iterator[tuple[int, int, str | None, str]]:
    """start, end, name (None: a comment or declaration) and text of each tag.

    A tag ends at the first ``>`` outside quotes.  Where the quotes of a page
    don't close, this and all later tags end at their first ``>``; a ``<`` without
    any is text.  What stands in a raw-text element belongs to its opening tag."""
    at, last, quoted = 0, page.rfind(">"), True
    ends: dict[str, re.Pattern] = {}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            yield start, end, None, ""
        elif start > last:
            return
        elif page[start + 1:start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
            yield start, end, None, ""
        elif (n := NAME.match(page, start)) is None:
            at = start + 1
            continue
        else:
            m = TAG.match(page, start) if quoted else None
            quoted = m is not None
            end = m.end() if m else page.find(">", start) + 1
            name, tag = n[1].lower(), page[start:end]
            if name in RAW and tag[1] != "/":
                if name not in ends:
                    ends[name] = re.compile(rf"</{name}\s*>", re.I)
                close = ends[name].search(page, end)
                end = close.end() if close else len(page)
            yield start, end, name, tag
        at = end


def holders(found: list) -> set[int]:
    """Places in ``tokens`` of elements that hold the article: an <article> or
    <main>, and forms that hold the heading of the page or most of its
    paragraphs."""
    out: set[int] = set()
    open_: list[tuple[str, int, int]] = []              # name, place, paragraphs before it
    counts: dict[str, int] = {}
    open_forms: list[int] = []
    paragraphs, forms = 0, []

    def mark(places: Iterator[int]) -> None:
        for at in places:
            if at in out:       # what holds this one was marked with it
                break
            out.add(at)

    for k, (_, _, name, tag) in enumerate(found):
        if name is None or name in RAW or name in VOID:
            continue
        if tag[1] == "/":
            if not counts.get(name):
                continue
            while open_:
                n, at, before = open_.pop()
                counts[n] -= 1
                if n == "form":
                    forms.append((open_forms.pop(), paragraphs - before))
                if n == name:
                    break
            continue
        if name in ("article", "main"):
            mark(at for _, at, _ in reversed(open_))
        elif name == "h1":
            mark(reversed(open_forms))
        elif name == "p":
            paragraphs += 1
            continue
        # only elements that can be left out are followed
        if name in CONTAINER or name in BLOCK:
            open_.append((name, k, paragraphs))
            counts[name] = counts.get(name, 0) + 1
            if name == "form":
                open_forms.append(k)
    forms += [(at, paragraphs - before) for n, at, before in open_ if n == "form"]
    out.update(at for at, inside in forms if inside >= 3 and 2 * inside > paragraphs)
    return out


def _attributes(tag: str) -> dict[str, str]:
    """The attributes that matter, by their names; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(tag, NAME.match(tag).end()):
        if (name := name.lower()) in READ and name not in out:
            out[name] = value.strip("\"'").lower()
    return out


def names_aside(value: str) -> bool:
    """A class or id says that its element is no article text: some name in it
    has a word of ``OUT_WORDS`` and no word that points elsewhere."""
    for name in value.split():
        words = [w for w in SPLIT.split(name) if w]
        if any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in NEUTRAL or len(w) < 3 for w in words):
            return True
    return False


def kind_of(name: str, a: dict[str, str]) -> str:
    return f"{name}.{a['class'].split()[0]}" if a.get("class", "").strip() else name


def left_out(name: str, a: dict[str, str], learned: frozenset = frozenset(), holds: bool = False) -> bool:
    if holds and "hidden" not in a and (name == "form" or name in BLOCK and name not in OUT):
        return False
    if name in OUT or a.get("role") in OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if name in ("html", "body", "main") or name not in BLOCK and name != "span":
        return False
    if any(names_aside(a.get(k, "")) for k in ("class", "id")):
        return True
    return kind_of(name, a) in learned


def events(page: str, learned: frozenset = frozenset()) -> Iterator[tuple]:
    """('text', raw, out, inside, stack) and ('tag', name, opening, out, inside, kind): ``out``: in an
    element left out (of tags: 1 if it begins there, 2 for all tags within and its end); ``inside``: in an article."""
    stack: list[tuple[str, bool, str]] = []  # name, left out, kind
    names: dict[str, int] = {}
    out = inside = 0
    found = list(tokens(page))
    holding = holders(found)

    def pop_to(i: int) -> None:
        nonlocal out, inside
        for name, o, _ in stack[i:]:
            out -= o
            inside -= name in ("article", "main")
            names[name] -= 1
        del stack[i:]

    at = 0
    for k, (start, end, name, tag) in enumerate(found):
        if start > at:
            yield "text", page[at:start], out > 0, inside > 0, stack
        at = end
        if name is None:
            continue
        if name in RAW and tag[1] != "/":  # raw text: never article text
            yield "tag", name, True, 2 if out else 1, inside > 0, name
            continue
        if tag[1] == "/":
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name) if names.get(name) else None
            if i is not None:
                was = inside > 0
                _, o, kind = stack[i]
                pop_to(i)
                yield "tag", name, False, 2 if out or o else 0, was and inside > 0, kind
            elif name in BLOCK or name == "br":
                yield "tag", name, False, 2 if out else 0, inside > 0, name
            continue
        a = _attributes(tag)
        if name in BLOCK:  # a block ends an open paragraph, an item the item before it
            closes = ENDS.get(name, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1) if any(names.get(c) for c in closes) else ():
                if stack[i][0] in closes:
                    pop_to(i)
                    break
                if stack[i][0] in CONTAINER or stack[i][0] in ("article", "main", "body", "td", "th", "li") and name not in ENDS.get(stack[i][0], ()):
                    break
        o = left_out(name, a, learned, k in holding)
        kind = kind_of(name, a)
        yield "tag", name, True, 2 if out else int(o), inside > 0, kind
        if name not in VOID and not tag.endswith("/>"):
            stack.append((name, o, kind))
            names[name] = names.get(name, 0) + 1
            out += o
            inside += name in ("article", "main")
    if at < len(page):
        yield "text", page[at:], out > 0, inside > 0, stack


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    """The text of the best region: blocks joined by line feeds."""
    blocks: list[list[str]] = [[]]  # pieces of raw text of each block
    marks: list[tuple[float, int, int]] = []  # score, block, piece (-1: a tag)
    for e in events(page or "", weights.out):
        if e[0] == "text":
            _, raw, out, _, _ = e
            if not out:
                text = html.unescape(raw)
                n = len(text.split())
                if n or blocks[-1]:
                    blocks[-1].append(text)
                if n:
                    marks.append((float(n), len(blocks) - 1, len(blocks[-1]) - 1))
            continue
        _, name, opening, out, inside, kind = e
        if inside:
            cost = INSIDE_COST
        elif out:
            cost = LEFT_OUT_COST
        elif name in ("article", "main") and not opening:
            cost = BARRIER
        else:
            cost = weights.cost.get(kind, weights.cost.get(name, TEXT_COST if name in TEXT_TAGS else UNKNOWN_COST))
        if out < 2:
            marks.append((-cost, len(blocks) - 1, -1))
        if name == "br":
            blocks[-1].append(" ")
        elif name in BLOCK and blocks[-1]:
            blocks.append([])
    best, here, start, region = 0.0, 0.0, 0, None
    for i, (score, _, _) in enumerate(marks):
        if here <= 0:
            here, start = 0.0, i
        here += score
        if here > best:
            best, region = here, (start, i + 1)
    if region is None:
        return ""
    pieces = [(b, p) for _, b, p in marks[region[0]:region[1]] if p >= 0]
    first, last = pieces[0], pieces[-1]
    found = []
    for b in range(first[0], last[0] + 1):
        s = first[1] if b == first[0] else 0
        t = last[1] + 1 if b == last[0] else None
        line = " ".join("".join(blocks[b][s:t]).split())
        if line:
            found.append(line)
    return "\n".join(found)


def learn_table(pages: DataFrame, column: str = "html") -> DataFrame:
    """kind, cost, out: every kind of element of the pages that mark their article."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string())] + [pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(4)],
                names=["kind", "tags_in", "tags_out", "words_in", "words_out"])
        for b in batches:
            for page in b.column(0).to_pylist():
                if not page or not re.search(r"<(article|main)[\s>]", page, re.I):
                    continue
                for e in events(page):
                    if e[0] == "tag":
                        for k in {e[5], e[1]}:
                            seen.setdefault(k, [0, 0, 0, 0])[0 if e[4] else 1] += 1
                    else:
                        n = len(e[1].split())
                        for k in {x[2] for x in e[4]}:
                            seen.setdefault(k, [0, 0, 0, 0])[2 if e[3] else 3] += n
                if len(seen) > 100_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    seen = (pages.select(F.col(column).cast("string")).mapInArrow(count, "kind string, tags_in bigint, tags_out bigint, words_in bigint, words_out bigint")
            .groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("tags_in", "tags_out", "words_in", "words_out"))))
    outside = (F.col("tags_out") + F.lit(0.5)) / (F.col("tags_in") + F.col("tags_out") + F.lit(1.0))
    container = F.col("kind").contains(".") & F.substring_index("kind", ".", 1).isin(*sorted(CONTAINER))
    return materialise(seen.select("kind", (F.lit(INSIDE_COST) + F.lit(5.0) * outside * outside).alias("cost"),
                                   (container & F.expr("words_out >= 100 and words_in < 0.01D * words_out")).alias("out")))


def _weights(rows) -> Weights:
    return Weights({r["kind"]: r["cost"] for r in rows}, frozenset(r["kind"] for r in rows if r["out"]))


def learn(pages: DataFrame, column: str = "html") -> Weights:
    """Weights from the pages that mark their article, all on the driver (``extract`` does so only when they are small)."""
    return _weights(learn_table(pages, column).collect())


def _main_texts(pages: Iterator[tuple[str | None, Weights]]) -> list[pa.Array]:
    got = [main_text(page, w) for page, w in pages]
    return [pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())]


def _extract_joined(src: DataFrame, table: DataFrame) -> DataFrame:
    """``extract`` with a table of kinds of any size: each page meets the rows of its own kinds."""
    src = store(src.withColumn("row", F.monotonically_increasing_id()), "pages")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = sorted({k for e in events(page or "") if e[0] == "tag" for k in (e[5], e[1])})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(found, pa.string())], names=["row", "kind"])

    own = materialise(src.select("row", "html").mapInArrow(kinds, "row bigint, kind string"))
    sized = table.join(own.groupBy("kind").agg(F.count(F.lit(1)).alias("pages")), "kind")
    known = join_hot(own, sized, "kind", "pages", own.count(), F.col("row")).where("cost is not null")
    per_page = known.groupBy("row").agg(F.collect_list(F.struct("kind", "cost", "out")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_main_texts((page, _weights(known or [])) for page, known in pages)], names=NAMES)

    return src.join(per_page, "row", "left").select("page_id", "url", "html", "known").mapInArrow(run, SCHEMA)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", column: str = "html",
            weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    src = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(column).cast("string").alias("html"))
    if weights is None:
        table = learn_table(pages, column)
        n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("kind")), F.lit(0))).first()  # two numbers
        if n > BROADCAST_KINDS or size > BROADCAST_BYTES:
            return _extract_joined(src, table)
        weights = _weights(table.collect())
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_main_texts((page, shared.value) for page in b.column(2).to_pylist())], names=NAMES)

    return src.mapInArrow(run, SCHEMA)

"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides what can be
told from a block alone: where it stands (menus, footers, adverts and the like), its
link density, its length and its density of stop words. The second pass gives blocks
too short or too odd to tell the label of the nearest decided neighbour; of two equally
near the good one counts. Within an article element neighbours are looked for in
the element only, and a block without any decided neighbour is kept.

Class and role names of a container say that it stands beside the article, unless it holds
an article element or more than half of the page's text: then they tell of the page (`has-sidebar`,
`search-page`). Names of comments count unless nothing else is left. Article elements are the text when they
hold most of it; beside teasers all blocks are judged. Stop words of the four known languages confirm a
block; a lack of them condemns none, and on a page of another language length has to do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import table

# Elements by what they mean for the text.
DROPPED = frozenset(
    "script style noscript template head title svg math canvas object embed iframe audio video select option textarea button datalist map".split()
)
ASIDE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Parts of class, id and role names of blocks that are not the article.
MARKED = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal"
    " overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar"
    " footer masthead comment comments respond replies disqus share sharing social related recommended recommendations copyright alert complementary"
    " contentinfo search".split()
)
#: Those of them that name readers' replies.
REPLIES = frozenset("comment comments respond replies disqus".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her him his how i if in into is it its just like me"
    " more my no not now of on one only or other our out over she so some than that the their them then there these they this to up us was we were what when"
    " which who will with would you your"
    " aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat haben ich ihr im in ist ja"
    " kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur"
    " au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mes mon ne nous on ou par pas plus pour qu que"
    " qui sa se ses son sont sur tu un une vous"
    " al como con cual cuando de del desde donde el ella ellos en entre era es esta este esto ha hay la las lo los más me mi muy ni nos o para pero por que quien"
    " se ser si sin sobre son su sus también te tiene todo un una uno y ya".split()
)
#: Characters of a short and of a long block; shares of stop words; share of link text.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKS = 70, 200, 0.15, 0.25, 0.34
#: Share of stop words from which a page is in one of the known languages; what a character of a script without spaces counts.
KNOWN_LANGUAGE, DENSE = 0.05, 3
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}


@dataclass
class Mark:
    """A container whose names say that it stands aside: whether they name replies, and whether it holds an article element."""

    replies: bool
    holds_article: bool = False
    length: int = 0


@dataclass
class Block:
    """Text pieces between two block boundaries; `article` numbers the enclosing article element, 0 for none.

    `aside` is sure; `marks` are the marked containers around it.
    """

    article: int
    aside: bool
    marks: tuple[Mark, ...] = ()
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _hidden(attributes: str) -> bool:
    return bool(attributes) and _HIDDEN.search(attributes) is not None


def _marked(attributes: str) -> set[str]:
    """The marking parts of a container's names."""
    if not attributes:
        return set()
    return {part.lower() for found in _NAMES.findall(attributes) for part in _PARTS.findall(" ".join(found))} & MARKED


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int, tuple[Mark, ...]]] = []  # open containers: name, and aside, article, marks around them
    aside, article, articles, links, breaks, at = False, 0, 0, 0, 0, 0
    marks: tuple[Mark, ...] = ()
    current = Block(0, False)

    def add(raw: str) -> None:
        nonlocal breaks
        if raw.strip():
            breaks = 0
        current.pieces.append(raw)
        if links:
            current.linked += len("".join(raw.split()))

    def close() -> None:
        nonlocal current, links, breaks
        current.text = " ".join(unescape("".join(current.pieces)).split())
        if current.text:
            blocks.append(current)
        current, links, breaks = Block(article, aside, marks), 0, 0

    while found := _TAG.search(page, at):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if not closing and name in DROPPED:
            if name in _ENDS:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in VOID or attributes.endswith("/"):
                continue
            depth, name_end = 1, re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>" + (r"|<body(?=[\s>])" if name == "head" else ""), re.I)
            while depth and (tag := name_end.search(page, at)):
                if tag[0].lower().startswith("<body"):
                    at = tag.start()
                    break
                at, depth = tag.end(), depth + (-1 if tag[1] else 1)
            if depth and not tag:
                at = len(page)
            continue
        if name == "br":
            add(" ")
            breaks += 1
            if breaks == 2:
                close()
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name not in BLOCK:
            continue
        if name in VOID or name == "p":
            hidden = aside
            if name == "p" and not closing and (_hidden(attributes) or _marked(attributes)):
                close()
                current.aside = True
                continue
            aside = hidden
            close()
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                outer = stack[depth]
                del stack[depth:]
                aside, article, marks = outer[1:]
        else:
            stack.append((name, aside, article, marks))
            if name in ARTICLE and not aside and not article:
                articles += 1
                article = articles
                for mark in marks:
                    mark.holds_article = True
            top = name in ("html", "body") or (name in ARTICLE)
            aside = aside or name in ASIDE or (name == "header" and not article) or (not top and _hidden(attributes))
            if not top and (found_marks := _marked(attributes)):
                marks = (*marks, Mark(bool(found_marks & REPLIES)))
        close()
    tail = page[at:]
    if tail:
        add(tail)
    close()
    return blocks


def _weight(text: str) -> int:
    return len(text) + (DENSE - 1) * len(_DENSE.findall(text))


def _stops(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def _decided(block: Block, known: bool) -> bool | None:
    """Good, bad, or None where the block alone doesn't tell; `known` if stop words of the page's language are known."""
    n = _weight(block.text)
    links = block.linked / max(1, len("".join(block.text.split())))
    if block.aside or links > LINKS:
        return False
    if not block.article and block.text[0] == "©":
        return False
    if n < SHORT:
        return None
    if not known:
        return True if n > LONG or block.article else None
    stops, words = _stops(block.text)
    if stops >= STOPS_HIGH * words:
        return True if n > LONG or block.article else None
    if stops >= STOPS_LOW * words:
        return True if block.article else None
    return None


def _placed(blocks: list[Block]) -> None:
    """Settle which marks count: `aside` holds for blocks within one that does."""
    free = [b for b in blocks if not b.aside]
    for block in free:
        for mark in block.marks:
            mark.length += len(block.text)
    total = sum(len(b.text) for b in free)
    outside = any(not b.marks and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text) for b in free)

    def counts(mark: Mark) -> bool:
        if mark.holds_article:
            return False
        return outside or 2 * mark.length <= total if mark.replies else 2 * mark.length <= total

    for block in free:
        block.aside = any(counts(mark) for mark in block.marks)


def main_text(page: str) -> str:
    """The blocks of the article, joined by newlines."""
    blocks = blocks_of(page)
    _placed(blocks)
    stops, words = (sum(x) for x in zip(*(_stops(b.text) for b in blocks if not b.aside), strict=True)) if any(not b.aside for b in blocks) else (0, 0)
    known = stops >= KNOWN_LANGUAGE * words
    inside = sum(_weight(b.text) for b in blocks if b.article and not b.aside)
    if inside and inside >= sum(_weight(b.text) for b in blocks if not b.article and _decided(b, known)):
        blocks = [b for b in blocks if b.article]
    first = [_decided(b, known) for b in blocks]
    kept = []
    last: list[tuple[int, bool] | None] = [None] * len(blocks)
    following: list[tuple[int, bool] | None] = [None] * len(blocks)
    for steps, near in ((range(len(blocks)), last), (range(len(blocks) - 1, -1, -1), following)):
        seen: tuple[int, bool] | None = None
        before = None
        for i in steps:
            if blocks[i].article != before:
                seen, before = None, blocks[i].article
            # what stands aside within an article says nothing about the text around it
            if first[i] is not None and not (blocks[i].article and blocks[i].aside):
                seen = (i, first[i])
            near[i] = seen
    good_somewhere = any(first)
    for i, block in enumerate(blocks):
        label = first[i]
        if label is None:
            near = [(abs(i - x[0]), not x[1]) for x in (last[i], following[i]) if x]
            label = not min(near)[1] if near else bool(block.article) or not good_somewhere
            if not label and not block.article and not good_somewhere and not block.linked:
                label = True
        if label:
            kept.append(block.text)
    return "\n".join(kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, from its whole html.

    Null and empty pages, and pages without an article, have an empty text. Cut-off
    pages are read as far as they go. Ids and urls pass as they are, null or
    repeated; extra columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))

"""Main text of web pages by consensus of their host: pages vote for the path of their main container, and are read by the winning path where it holds their article."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, join_group_facts, shared_checkpoint

#: Share of a page's text that its main container holds at least, and share of links that makes a block outside it a menu.
MAIN_SHARE, MENU_SHARE = 0.8, 0.5
#: Characters of hosts and their winning paths that may be broadcast together.
BROADCAST_CHARS = 10_000_000
#: Longer paths and names are cut and end in a digest; elements nested deeper stand for their ancestor, as in browsers.
LONGEST_PATH, LONGEST_NAME, DEEPEST = 400, 100, 512

# Elements by their role in the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside blockquote caption dd details dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li menu nav ol p pre "
    "select summary ul th thead tfoot head button dialog".split()
)
# Elements and class or id words of what isn't the article.
ASIDE_TAGS = frozenset("nav header footer aside form head button select dialog menu svg object".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer "
    "footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related "
    "reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that a class may have beside those of an aside: 'comments-list' is one, 'no-sidebar' and 'post-header' are none.
HOLDER_WORDS = frozenset("area block bar bottom box container global inner items left links list main outer posts primary right secondary section site top wrap wrapper".split())
# Beginnings, and whole words, that name comments and adverts in any class, unless it says that there are none or that others lie beside it.
ASIDE_STEMS = ("comment", "advert", "sponsor", "disqus")
ASIDE_ANYWHERE = frozenset("ad ads adslot adslots adbox adunit adsense adzone".split())
NO_ASIDE = frozenset("commentary commentaries commentator commented no not non has with without hide hidden".split())
#: Elements that no class makes an aside, those that name the article, and asides of which some hold it.
PAGE_TAGS = frozenset("html body main article".split())
LANDMARKS = frozenset("main article h1".split())
DOUBTFUL_TAGS = frozenset("form header".split())

# A tag ends at the first > outside quotes; one with broken quotes, at the first >. No part is read twice, and so many pieces at most.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:[^<>"']++|"[^"]*+"|'[^']*+'){0,100}+)>|([^<>]*+)>)""", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


@dataclass
class _Mark:
    """A container that looks like an aside, and what it holds."""

    around: int
    size: int = 0
    landmark: bool = False
    article: bool = False


@dataclass
class _Element:
    tag: str
    path: str
    aside: bool
    marks: tuple[_Mark, ...] = ()
    articles: int = 0
    #: Whether it is or lies in an article or main element, and the paths of the containers around its text, the outermost first.
    article: bool = False
    around: tuple[str, ...] = ()


@dataclass
class _Block:
    text: str
    linked: int
    inside: tuple[str, ...] = ()
    article: bool = False
    marks: tuple[_Mark, ...] = ()
    #: Whether it is a page's or a section's title.
    title: bool = False


_OUTSIDE = _Element("", "", False)


def _says_aside(values: str) -> bool:
    """Whether a whole class, id or role names an aside."""
    for token in values.split():
        parts = set(_PART.findall(token))
        if parts & ASIDE_WORDS and parts <= ASIDE_WORDS | HOLDER_WORDS:
            return True
        if not parts & NO_ASIDE and (parts & ASIDE_ANYWHERE or any(p.startswith(ASIDE_STEMS) for p in parts)):
            return True
    return False


def _cut(name: str, most: int) -> str:
    return name if len(name) <= most else f"{name[:most]}~{md5(name.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}"


def _element(tag: str, attributes: str, parent: _Element, depth: int) -> _Element:
    """An element with its path, in which classes and ids lose their digits, and the marks on it and around it."""
    by_tag = tag in ASIDE_TAGS and not (tag == "header" and parent.article)
    aside = parent.aside or (by_tag and tag not in DOUBTFUL_TAGS)
    if depth >= DEEPEST:
        return _Element(tag, parent.path, aside, parent.marks, parent.articles, parent.article, parent.around)
    named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMED.finditer(attributes)} if attributes else {}
    marks = parent.marks
    said = _says_aside(" ".join(named.values()))
    if tag in LANDMARKS and not said and not aside:
        for m in marks:
            m.landmark = True
            m.article |= tag != "h1"
    if (by_tag or said) and tag not in PAGE_TAGS:
        marks = (*marks, _Mark(parent.articles))
    name = tag + "".join("." + re.sub(r"\d+", "", c) for c in sorted(named.get("class", "").split()))
    if "class" not in named and "id" in named:
        name += "#" + re.sub(r"\d+", "", named["id"])
    above = parent.path if len(parent.path) <= LONGEST_PATH else _cut(parent.path, LONGEST_NAME)
    path = f"{above}>{_cut(name, LONGEST_NAME)}" if above else _cut(name, LONGEST_NAME)
    around = (*parent.around, path) if tag in CONTAINERS else parent.around
    named_article = tag in ("main", "article")
    return _Element(tag, path, aside, marks, parent.articles + (named_article and not marks), parent.article or named_article, around)


def blocks_of(page: str) -> list[_Block]:
    """Blocks of text outside menus, notices and the like, in page order, with the paths of the containers around each."""
    out: list[_Block] = []
    stack: list[_Element] = []
    held: list[str] = []
    linked = links = at = 0
    outside: Counter[str] = Counter()
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            top = stack[-1] if stack else _OUTSIDE
            if text and not top.aside:
                for m in top.marks:
                    m.size += len(text)
                out.append(_Block(text, linked, top.around, top.article, top.marks, top.tag in ("h1", "h2")))
        held, linked = [], 0

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        said = page[at : m.start()] if m else page[at:]
        if said:
            held.append(said)
            if links:
                linked += len(said)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        links = 0
        if closing:
            while opened[tag]:
                top = stack.pop()
                opened[top.tag] -= 1
                if top.tag == tag:
                    break
        elif tag not in VOID:
            # A paragraph ends where a block begins, and an item where the next one does.
            if stack and (stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "td", "tr", "th", "dt", "dd", "option"))):
                opened[stack.pop().tag] -= 1
            stack.append(_element(tag, m[3] or m[4] or "", stack[-1] if stack else _OUTSIDE, len(stack)))
            opened[tag] += 1
            if tag in LANDMARKS and not stack[-1].aside and not stack[-1].marks:
                outside[tag] += 1
    flush()
    total = sum(len(b.text) for b in out)

    def stands(m: _Mark) -> bool:
        """A mark is void on what holds the page's only article or heading, or most of its text where no article is elsewhere."""
        if outside["main"] + outside["article"] > m.around:
            return True
        return not (m.article or (m.landmark and not outside["h1"]) or 2 * m.size > total)

    return [b for b in out if not any(map(stands, b.marks))]


def _article(blocks: list[_Block], share: float) -> list[_Block]:
    """The blocks that belong to the article for themselves: those of article or main elements and of the deepest container with `share` of the page's text.

    Links don't count for that share. Without such elements all blocks belong to it that don't consist of links for the most part, and those of that container.
    """
    scores: Counter[str] = Counter()
    depth: dict[str, int] = {}
    total = 0
    for b in blocks:
        own = max(len(b.text) - b.linked, 0)
        total += own
        for i, path in enumerate(b.inside):
            scores[path] += own
            depth[path] = i
    fit = [p for p, n in scores.items() if n >= share * total and n > 0]
    deepest = max(fit, key=lambda p: (depth[p], p), default="")
    if any(b.article for b in blocks):
        return [b for b in blocks if b.article or deepest in b.inside]
    return [b for b in blocks if deepest in b.inside or b.linked <= MENU_SHARE * len(b.text)] if deepest else blocks


def main_path(blocks: list[_Block], share: float = MAIN_SHARE) -> str:
    """The path of the smallest container that holds the whole article; empty if there is none.

    A page without article or main elements votes for the layout around it, as far up as the body.
    """
    needed = _article(blocks, share)
    if not any(len(b.text) > b.linked for b in needed):
        return ""
    shared = set(needed[0].inside).intersection(*(b.inside for b in needed))
    depth = {path: i for i, path in enumerate(needed[0].inside)}
    place = lambda p: (depth[p], p)
    if not any(b.article for b in needed):
        layout = [p for p in shared if _tag(p) not in ("html", "body")]
        return min(layout or shared, key=place, default="")
    return max(shared, key=place, default="")


def _tag(path: str) -> str:
    return re.split(r"[.#]", path.rsplit(">", 1)[-1], maxsplit=1)[0]


def text_by_path(blocks: list[_Block], path: str | None) -> str:
    """The article's own blocks, and all within the host's path if that holds them; titles before them, too."""
    mine = _article(blocks, MAIN_SHARE)
    if path and all(path in b.inside for b in mine):
        ids = set(map(id, mine))
        mine = [b for b in blocks if path in b.inside and (id(b) in ids or b.linked <= MENU_SHARE * len(b.text))]
    first = next((i for i, b in enumerate(blocks) if mine and b is mine[0]), 0)
    return "\n".join(b.text for b in [*(b for b in blocks[:first] if b.title), *mine])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [main_path(blocks_of(h or "")) or None for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("host"), pa.array(paths, pa.string())], ["host", "own"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_by_path(blocks_of(h or ""), p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """The path that most pages of a host vote for: rows (host, votes, path), votes being those of all its paths. Ties go to the greater path."""
    counted = pages.select("host", "html").mapInArrow(_votes, "host string, own string").where("own is not null").groupBy("host", "own").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("host").agg(F.sum("n").alias("votes"), F.max(F.struct("n", "own"))["own"].alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Takes any frame with page_id, url and html; further columns are ignored. A page is read by its host's winning path where that holds
    the page's own main container, so the consensus adds what a page's own score leaves out and drops nothing of it. Pages without a host
    share one vote. Null or empty html has an empty text; null ids and repeated rows stay as they are; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    winners = shared_checkpoint(host_paths(rows))
    chars = winners.agg(F.sum(F.length("host") + F.length("path") + 50)).first()[0] or 0
    met = rows.join(F.broadcast(winners), "host", "left") if chars <= BROADCAST_CHARS else join_group_facts(rows, winners, "host", "votes")
    return met.select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")

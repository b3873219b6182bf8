"""Main text of web pages by deduction of the template that pages of one host share.

1. A page is read into tokens: each tag by its path of open elements (with class, id and role), each text block by its path and words.
   Per page every token has a number of occurrences.
2. Over the pages of a host a token's occurrence vector says how often each page has it. Tokens with one vector form an
   equivalence class. Vectors are as long as a host has pages, so they are compared by a sum of hashes of (page, count), which Spark
   adds up before the shuffle: a host with a third of all pages costs each task its distinct tokens.
3. A class is valid if it is frequent (in at least ``support`` of the host's pages) and its tokens occur equally often in each, once or more.
   Valid classes nest: a class lies in the slot of the class that has the deepest tag around all its own tags. Together they
   are the host's template; what stands between its tags is in its slots.
4. Of the slots, one is followed down from the page's root as long as it holds most of the words that vary: the main slot. On pages with
   ``article`` or ``main`` these are it. What is left in it after removing the template's own blocks is the page's text: blocks that a host repeats on
   (nearly) every page are no content, in articles and outside.

Element rules (scripts, menus, forms, marked adverts and comments) hold in every page; on hosts with few pages, which have no frequent
class, they decide alone.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import small_batches, stored
from tasksieve.llm.url_links import host_of


@dataclass(frozen=True)
class TemplateDeduction:
    """min_pages: fewest pages of a host with a template; support: least share of them that has a class's tokens; main_share: of the varying
    words that the main slot holds; repeats: pages a host must have for repeated blocks within an article to go (headings stay, and a
    page's text keeps at least half its words); templates of all hosts up to broadcast_bytes are sent to every task."""

    min_pages: int = 3
    support: float = 0.9
    main_share: float = 0.6
    repeats: int = 8
    broadcast_bytes: int = 16 << 20


#: Elements whose content is never main text.
_NEVER = frozenset("script style noscript template svg iframe object embed applet canvas audio video map head title nav footer aside form "
                   "button select option textarea input label fieldset dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
#: Elements that stand in a line of text; all others begin and end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike "
                    "strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt msup msub msubsup".split())
#: Words of class, id or role that mark boilerplate.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget widgets complementary contentinfo search toolbar "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login register form "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations trending "
    "copyright legal disclaimer skip hidden noprint".split()
)
#: A quote opens a value only behind "="; elsewhere it is an ordinary character.
_VALUE = r"""=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{_VALUE})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+))|([^\s=/>]+)""", re.S)
#: Words of layout that a marked name can hold besides.
_LAYOUT = frozenset("site main top bottom left right global primary secondary container wrapper wrap box block inner outer area section bar list item items "
                    "link links icon icons button buttons panel column col row group holder first last left right".split())
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: An end tag or a start tag of these closes an open element of the listed kinds.
_CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


#: Ids of comment sections, in articles too, where other ids are often made of headings.
_COMMENT_IDS = frozenset("comments respond comment-list commentlist comment-section disqus_thread".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Deeper elements are read as the others but are no tokens; longer labels are cut.
_DEEPEST, _LONGEST = 64, 200


class _Open(NamedTuple):
    """An open element: its path as a template has it (None if too deep), the path of its outermost article or main element."""

    name: str
    path: str | None
    depth: int
    main: str | None
    boilerplate: bool
    never: bool
    heading: bool


_OUTSIDE = _Open("", "", 0, None, False, False, False)


@dataclass
class Page:
    """Text pieces as (place of the block, innermost element, text), tag paths with counts."""

    texts: list[tuple[int, _Open, str]] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)


@functools.lru_cache(maxsize=4096)
def _label(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The element as the path has it, whether it is marked as boilerplate, and whether it is so inside main text too.

    Ids are often made of headings and classes name what is the article's own: only attributes that hide, and names of marks and words
    of layout count; inside main text names of nothing but marks, no ``header``, and of ids those of comment sections alone.
    """
    found, marked, inside = [], False, False
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            key = (m[1] or m[5] or "").lower()
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            if key in ("class", "id", "role"):
                found.append(f"{key}={value}")
                names = [[p.lower() for p in _NAME_PARTS.findall(n)] for n in value.split()]
                telling = [parts for parts in names if any(p in _MARKS for p in parts) and all(p in _MARKS or p in _LAYOUT for p in parts)]
                marked |= bool(telling)
                if key == "id":
                    inside |= value.strip().lower() in _COMMENT_IDS
                else:
                    inside |= any(parts != ["header"] and all(p in _MARKS for p in parts) for parts in telling)
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                marked = inside = True
    return (name + "".join(f"[{x}]" for x in found))[:_LONGEST].replace("/", "%"), marked or inside, inside


def read_page(source: str, forms: bool = False) -> Page:
    """Tolerant of what pages do: unclosed and stray tags, cut off ends, tags inside scripts and comments.

    ``forms``: forms hold text like other elements.
    """
    page, stack, names, alike, block, at = Page(), [], Counter(), {}, 0, 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        inner = stack[-1] if stack else _OUTSIDE
        if text:
            page.texts.append((block, inner, text))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            page.texts.append((block, inner, html.escape(m[0][9:].removesuffix("]]>"), quote=False)))
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            page.texts.append((block, inner, " "))
        elif name not in _INLINE:
            block += 1
        if m[1]:
            _close(stack, names, name)
            continue
        _close_implied(stack, names, name)
        attributes = m[3] or ""
        inner = stack[-1] if stack else _OUTSIDE
        # Elements that open alike in the same place are one object.
        key = (id(inner), name, attributes)
        opened = alike.get(key)
        if opened is None:
            opened = alike[key] = _opened(inner, name, attributes, forms)
        if opened.path is not None:
            page.tags[opened.path] += 1
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(source, at)
            at = end.start() if end else len(source)
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append(opened)
            names[name] += 1
    return page


def _opened(above: _Open, name: str, attributes: str, forms: bool) -> _Open:
    label, marked, inside = _label(name, attributes)
    path = None if above.path is None or above.depth >= _DEEPEST else f"{above.path}/{label}" if above.depth else label
    never = name in _NEVER and not (forms and name == "form")
    outermost = above.main is None and (name in ("article", "main") or "[role=main]" in label)
    if outermost and not inside:
        # A wrapper with a telling class, or a form, may hold the whole page; only other elements that never hold main text keep it out.
        # A telling id or part of a class decides in a marked wrapper only, as of a comment among comments.
        boilerplate = above.never or name == "article" and marked and above.boilerplate
    elif outermost or above.main is not None:
        boilerplate = never or inside or above.boilerplate
    else:
        boilerplate = never or name == "header" or marked and name not in ("html", "body") or above.boilerplate
    main = above.main if above.main is not None else (path or label) if outermost else None
    return _Open(name, path, above.depth + 1, main, boilerplate, above.never or never and name != "form", above.heading or name in _HEADINGS)


def _pop(stack: list[_Open], names: Counter, to: int) -> None:
    for e in stack[to:]:
        names[e.name] -= 1
    del stack[to:]


def _close(stack: list[_Open], names: Counter, name: str) -> None:
    """An end tag closes its element and what is open in it; a stray inline one closes nothing beyond a block."""
    if names[name] <= 0:
        return
    k = len(stack) - 1
    while stack[k].name != name:
        if name in _INLINE and stack[k].name not in _INLINE:
            return
        k -= 1
    _pop(stack, names, k)


def _close_implied(stack: list[_Open], names: Counter, name: str) -> None:
    """A start tag ends the paragraph, item or cell before it; inline elements left open do not keep those open."""
    ended = _CLOSES.get(name, ()) + (("p",) if name in _CLOSE_P else ())
    k = len(stack)
    while k and any(names[e] > 0 for e in ended) and (stack[k - 1].name in _INLINE or stack[k - 1].name in ended):
        k -= 1
        if stack[k].name in ended:
            _pop(stack, names, k)


def _blocks(page: Page) -> list[tuple[_Open, str, list[tuple[_Open, str]]]]:
    """The blocks in page order: innermost element of the first piece with text, the block's text, its pieces."""
    found: dict[int, list[tuple[_Open, str]]] = {}
    for block, inner, text in page.texts:
        found.setdefault(block, []).append((inner, text))
    rows = []
    for _, pieces in sorted(found.items()):
        text = _joined(pieces)
        if text:
            rows.append((next(e for e, t in pieces if t.strip()), text, pieces))
    return rows


def _joined(pieces: list[tuple[_Open, str]]) -> str:
    text = "".join([t for _, t in pieces])
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _part(blocks: list[tuple], wanted: Callable[[_Open], bool]) -> list[tuple]:
    """The blocks' pieces in the elements wanted; blocks without text there go."""
    found = []
    for inner, text, pieces in blocks:
        own = [x for x in pieces if wanted(x[0])]
        if len(own) < len(pieces):
            text = _joined(own) if own else ""
        if text:
            found.append((inner, text, own))
    return found


def _block_token(inner: _Open, text: str) -> str:
    """A block as a token: the path of its element and its words, or their digest if they are long."""
    return f"={inner.path or '...'}|{text if len(text) <= 80 else hashlib.md5(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


def token_counts(page: Page) -> tuple[Counter, Counter]:
    """Occurrences of the page's tokens, tags and blocks, and the numbers of words that its elements hold themselves."""
    counts, words = Counter({f"<{path}": n for path, n in page.tags.items()}), Counter()
    for inner, text, pieces in _blocks(page):
        counts[_block_token(inner, text)] += 1
        for e, t in pieces:
            if e.path and not e.boilerplate and t.strip():
                words[f"#{e.path}"] += len(t.split())
    return counts, words


def _above(path: str):
    """The path and those of the elements around it, from the inside out."""
    while path:
        yield path
        path = path.rpartition("/")[0]


@dataclass(frozen=True)
class Template:
    """A host's template: its fixed blocks, the paths of its tags, and the main slot: the tag that holds most of what varies ('': none)."""

    fixed: frozenset[str] = frozenset()
    main: str = ""
    n_pages: int = 0


def nested(classes: list[list[str]]) -> tuple[list[frozenset[str]], list[int]]:
    """The classes, and for each the one it lies in (-1: none): the class with the deepest tag that is around all its own tokens."""
    sets = sorted((frozenset(c) for c in classes), key=sorted)
    owner = {t[1:]: k for k, c in enumerate(sets) for t in c if t[0] == "<"}
    parents = []
    for k, tokens in enumerate(sets):
        paths = [t[1:] if t[0] == "<" else t[1 : t.index("|")] for t in tokens]
        shared = paths[0].split("/")
        for path in paths[1:]:
            own = path.split("/")
            shared = shared[: next((i for i, (a, b) in enumerate(zip(shared, own)) if a != b), min(len(shared), len(own)))]
        parents.append(next((owner[p] for p in _above("/".join(shared)) if owner.get(p, k) != k), -1))
    return sets, parents


def main_slot(classes: list[list[str]], words: dict[str, int], share: float) -> str:
    """The slot that most of the varying words are in, as the path of the template's tag around it.

    From the outermost classes on, the slot of the nested class that holds ``share`` of the words of the one before is entered;
    ``words`` are those of elements, less those of the classes' own blocks.
    """
    sets, parents = nested(classes)
    tags = {t[1:]: k for k, c in enumerate(sets) for t in c if t[0] == "<"}
    volume: Counter = Counter()
    for path, n in words.items():
        for p in _above(path):
            if p in tags:
                volume[p] += n
    if not volume:
        return ""

    def depth(k: int) -> int:
        n = 0
        while parents[k] >= 0:
            k, n = parents[k], n + 1
        return n

    now, total = "", max(volume.values())
    for path in sorted(volume, key=lambda p: (p.count("/"), depth(tags[p]))):
        if (not now or path.startswith(f"{now}/")) and volume[path] >= share * total:
            now, total = path, volume[path]
    return now


def _template_of(n_pages: int, classes: list[list[str]], words: dict[str, int], op: TemplateDeduction) -> dict:
    """A template as JSON has it. The words of fixed blocks are the template's and vary with no page."""
    fixed = sorted({t for c in classes for t in c if t[0] == "="})
    varying = dict(words)
    for token in fixed:
        path, _, text = token[1:].partition("|")
        if path in varying:
            varying[path] -= n_pages * len(text.split())
    main = main_slot(classes, {p: n for p, n in varying.items() if n > 0}, op.main_share)
    return {"fixed": fixed, "main": main, "n_pages": n_pages}


def extract(page: Page, template: Template = Template(), op: TemplateDeduction = TemplateDeduction()) -> str:
    """The blocks of the page's articles, else of the template's main slot, else of its body, less what the template fixes; joined by newlines."""
    shown = _part(_blocks(page), lambda e: not e.boilerplate)
    inside = _part(shown, lambda e: e.main is not None)
    if inside:
        shown = inside
    elif template.main:
        shown = _part(shown, lambda e: e.path is not None and (e.path == template.main or e.path.startswith(f"{template.main}/"))) or shown
    lines = [(text, _block_token(e, text) in template.fixed, e.heading) for e, text, _ in shown]
    size = sum(len(line) for line, *_ in lines)
    repeated = sum(len(line) for line, fixed, _ in lines if fixed)
    if inside:
        # What an article shares with all others of its host by chance, as a heading, stays its own.
        drop = template.n_pages >= op.repeats and 2 * repeated < size
        return "\n".join(line for line, fixed, heading in lines if not (drop and fixed and not heading))
    return "\n".join(line for line, fixed, _ in lines if not (fixed and repeated < size))


_VECTOR = "host string, token string, pages bigint, total bigint, least bigint, most bigint, sum_high bigint, sum_low bigint"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors' parts: per host and token of a batch the pages, counts and sums of hashes of (page, count)."""
    kinds = [pa.string(), pa.string()] + [pa.int64()] * 6
    for batch in batches:
        found: dict[tuple[str, str], list[int]] = {}
        for host, key, source in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            counts, words = token_counts(read_page(source or ""))
            for token, n in [*counts.items(), *words.items()]:
                hashed = (key ^ n * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
                hashed ^= hashed >> 31
                old = found.setdefault((host, token), [0, 0, n, n, 0, 0])
                found[host, token] = [old[0] + 1, old[1] + n, min(old[2], n), max(old[3], n), old[4] + (hashed >> 34), old[5] + (hashed & 0x3FFFFFFF)]
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _VECTOR.split(", ")])


def templates(pages: DataFrame, op: TemplateDeduction = TemplateDeduction()) -> DataFrame:
    """``(host, n_pages, classes, words)`` of hosts with at least ``min_pages`` pages: the valid frequent equivalence classes, and the
    words of the elements in at least a tenth of the pages.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("key"), "html")
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= op.min_pages)
    parts = rows.mapInArrow(_vectors, _VECTOR)
    vectors = parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum("sum_high").alias("sum_high"), F.sum("sum_low").alias("sum_low"),
    )
    word = F.col("token").startswith("#")
    # What only a few pages have is frequent nowhere: most blocks are left out before a host's tokens come together.
    repeated = vectors.where(word | ((F.col("least") == F.col("most")) & (F.col("pages") >= op.support * op.min_pages)))
    frequent = repeated.join(sizes, "host").where(
        (word & (F.col("pages") >= 0.1 * F.col("n_pages"))) | (~word & (F.col("pages") >= op.support * F.col("n_pages")))
    )
    # A frequent class has no more tokens than a page, and a host at most 1 / support times as many in all classes; of elements with words
    # it has at most ten times as many as a page.
    classes = frequent.groupBy("host", "n_pages", word.alias("word"), *[F.when(~word, F.col(c)).alias(c) for c in ("pages", "total", "sum_high", "sum_low")]).agg(
        F.array_sort(F.collect_list(F.struct("token", F.col("total").alias("n")))).alias("tokens")
    )
    return classes.groupBy("host", "n_pages").agg(
        F.array_sort(F.collect_list(F.when(~F.col("word"), F.col("tokens.token")))).alias("classes"), F.first(F.when(F.col("word"), F.col("tokens")), ignorenulls=True).alias("words"),
    )


def _deducer(op: TemplateDeduction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                json.dumps(_template_of(n, classes, {w["token"][1:]: w["n"] for w in words or ()}, op))
                for n, classes, words in zip(*(batch.column(c).to_pylist() for c in ("n_pages", "classes", "words")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], ["host", "template"])

    return run


_MADE: dict[str, Template] = {}


def _template(made: str | None) -> Template:
    if made is None:
        return Template()
    if made not in _MADE:
        if len(_MADE) > 1000:
            _MADE.clear()
        found = json.loads(made)
        _MADE[made] = Template(frozenset(found["fixed"]), found["main"], found["n_pages"])
    return _MADE[made]


def page_text(source: str, template: Template = Template(), op: TemplateDeduction = TemplateDeduction()) -> str:
    """The main text of one page; where a form holds everything, forms are read as other elements."""
    return extract(read_page(source), template, op) or ("<form" in source.lower() and extract(read_page(source, forms=True), template, op)) or ""


def _extractor(op: TemplateDeduction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h or "", _template(t), op) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
            ], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, op: TemplateDeduction = TemplateDeduction()) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. Pages with a null url or one without host share the host ''. Repeated rows are extracted
    each and count as pages of their host (what would take most of a text away is not dropped); other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    made = stored(templates(rows, op).mapInArrow(_deducer(op), "host string, template string"), "templates")
    size = made.agg(F.coalesce(F.sum(F.octet_length("template")), F.lit(0))).first()[0]
    # The texts stay where they are if the templates are small; else both sides are shuffled by host and hot hosts split.
    joined = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(made) if size <= op.broadcast_bytes else made, "host", "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extractor(op), "page_id bigint, url string, text string, n_chars bigint")

"""HTML extraction by equivalence-class template deduction.

A page is read as tokens: its tags, each told apart by its path of tag names and classes from the root (its
role), and the text of its slots, told apart by path and words. Over the pages of one host, tokens with
the same occurrence vector (how often each occurs on every page) form an equivalence class. Vectors are
compared by checksums that add up page by page (two sums, so that repeated pages count and don't cancel), so
hosts of any size are summed in partial aggregates and no task holds a host.

A class is valid for the template if it has at least ``support`` pages and ``TOKENS`` tokens; classes nest as their paths do: the root class holds the
tokens that stand once on every page, and a class whose paths extend those of another stands in one of its
slots. A slot outside articles is a path and a place among the texts of that path; it is fixed if its words are in its own
class (the same words whenever the slot is there), else it varies. What the template keeps for itself is not the article:

* a slot whose path has a tag for menus, headers, footers, sidebars, forms, scripts or styles, or a class or
  id naming adverts, notices, comments and the like (whole, or in its first or last part), unless that holds most of
  the page's text and is a form, was left open or is only part of a name;
* a fixed slot outside the article, and words outside it that are in the root class, the same once on every page.

If the page has text inside an ``article`` or ``main`` tag that is not a comment or a teaser by its class, that remains, and of
the rest the text at paths that have varying slots; all of the rest if it is longer than the text inside. Without such a
tag all slots remain that are not the template's. Text inside the article is never dropped for being common: copied
articles and common lines stay. A page all of whose slots are fixed (copies of one page) keeps them. Below ``support`` pages a host has no classes and the path rules alone decide.

References are decoded, white space in a block becomes one space, blocks are joined in page order by one space.

Defined results: null and empty pages have empty text. A page without a host shares no template. Repeated
pages count as pages of their host. Unclosed, crossed and stray tags are closed as their block ends; a cut-off
page ends where it ends, and a tag cut off there is no text. An empty comment (``<!-->``) holds nothing. A body or any content closes the head. An
article or main tag is the article whatever stands around it, unless that is readers' comments, a closed aside or footer, or related posts. Only scripts, styles, titles, frames, text areas and
noscript are raw; formulas and an object's fallback are text. A tag with an odd quote ends at its first ``>``.
An empty table gives an empty result. The input's columns come back in ``row``.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .op8_url_filters import host_of

SUPPORT = 3
#: Least tokens of a valid class.
TOKENS = 2

_RAW = "script|style|noscript|textarea|iframe|title"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(?:(?<=[\s\"']/>)|.*?</(?P=raw)\s*>|.*\Z)|<(?P<shut>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|</?[a-z][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[-_0-9]+|(?<=[a-z])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html head body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br button label".split())
_AWAY = frozenset("head nav header footer aside form menu button dialog label fieldset input template svg select annotation annotation-xml".split())
#: A block opened in one of these closes it, but for what it may hold.
_NARROW, _NARROW_HOLDS = frozenset("svg math select".split()), frozenset("option optgroup hr button br".split())
_SECTIONS = frozenset("h1 h2 h3 h4 h5 h6 hgroup section".split())
_PASSES_HEAD = frozenset("html head base basefont bgsound link meta template".split())
_READERS = frozenset("comment comments disqus respond replies discussion".split())
_ASIDES = frozenset("aside complementary related recommended".split())
_AWAY_NAMES = _READERS | _ASIDES | frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer sidebar sidebars contentinfo "
    "cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay newsletter subscribe subscription signup login search form forms share sharing social widget widgets toolbar skip paywall".split()
)
#: A paragraph's own warning, not a notice of the site.
_TEXTS, _CALLOUTS = frozenset("p li td th blockquote span strong em".split()), frozenset("notice notices alert alerts".split())
#: Classes of article elements that are not the page's article.
_TEASERS = frozenset("teaser teasers related recommended promo promos promotion sponsored sponsor advert advertisement ad ads reply".split())
#: First and last parts of class names that say what a page has or is filed under, and classes of whole pages.
_HAS = frozenset("has no with without is not hide show js tag category cat term topic status type format".split())
_STATE = frozenset("open closed enabled disabled on off active visible hidden layout page template".split())
_PAGES = frozenset("page layout".split())
#: From so many characters on, a wrapper that holds most of a page's text is the page's text.
_MOST = 200
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_WRAPS = frozenset("nav header footer aside form menu".split())
_CONTAINERS = frozenset("body article main section div nav header footer aside form table td th ul ol dl blockquote".split())


class Block(NamedTuple):
    path: str
    away: bool
    article: bool
    text: str


class _Cause:
    """Why an element is not the article: its tag, or a name; kind is readers, aside, tag, name or part (of a name).
    ``around``: the cause around an article that this one stands for inside it."""

    def __init__(self, kind: str, tag: str, around: _Cause | None = None):
        self.kind, self.tag, self.around, self.shut = kind, tag, around, False

    def left_open(self) -> bool:
        of = self.around or self
        return of.tag in _WRAPS and not of.shut

    def loose(self) -> bool:
        """Whether it may stand around the article: forms, what was never closed, and parts of names."""
        return self.kind == "part" or self.tag == "form" or self.left_open()


class _Open(NamedTuple):
    name: str
    path: str
    causes: tuple[_Cause, ...]
    article: bool
    own: _Cause | None = None

    @property
    def away(self) -> bool:
        return bool(self.causes)


def _named_away(names: list[tuple[str, str]], article: bool, away: frozenset[str] = _AWAY_NAMES) -> tuple[str, bool] | None:
    """The class, id or role that tells an element from the article, and whether it is that name as a whole. Of a
    name in parts (by hyphens, digits or capitals) the first and the last count; for readers' comments, all."""
    found = None
    words = {w for _, value in names for w in value.split()}
    whole = {w.lower() for w in words}
    for word in sorted(words):
        parts = [x.lower() for x in _PARTS.split(word) if x]
        if len(parts) > 1 and (parts[0] in _HAS or parts[-1] in _STATE):
            continue
        if article:  # an article's own heading is its text
            parts = [x for x in parts if x not in ("header", "masthead")]
        if hit := next((x for x in parts if x in _READERS), None):
            return hit, True
        if parts and not whole & _PAGES and (hit := next((x for x in (parts[0], parts[-1]) if x in away), None)):
            if found is None or hit in _ASIDES:
                found = hit, len(parts) == 1 or hit in _ASIDES
    return found


def read_page(page: str) -> tuple[list[Block], Counter]:
    """Text blocks of a page, and how often each tag occurs by its path."""
    blocks, tags, stack, piece = [], Counter(), [_Open("", "", (), False)], []
    words_of = []

    def flush() -> None:
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            if text:
                top = words_of[-1]
                blocks.append((top, text))
            piece.clear()

    def close(at: int) -> None:
        if any(o.name in _BLOCK for o in stack[at:]):
            flush()
        del stack[at:]

    def say(text: str) -> None:
        if text:
            if stack[-1].name == "head" and not text.isspace():
                close(len(stack) - 1)
            if not piece:
                words_of[:] = [block_of()]
            piece.append(text)

    def block_of() -> _Open:
        return next((o for o in reversed(stack) if o.name in _BLOCK or o.away), stack[0])

    done = 0
    for m in _TOKEN.finditer(page):
        away_now = stack[-1].away
        if piece and away_now != words_of[-1].away:
            flush()
        say(page[done : m.start()])
        done = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                tags[f"{stack[-1].path}/{m['raw'].lower()}"] += 1
            continue
        if m["shut"]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name or (stack[k].name in _CONTAINERS and name not in _CONTAINERS and name not in ("html", "head"))), 0)
            if at and stack[at].name == name:
                if stack[at].own:
                    stack[at].own.shut = True
                close(at)
            elif name == "br":
                say(" ")
            continue
        if name == "body" or (stack[-1].name == "head" and name not in _PASSES_HEAD):
            at = next((k for k, o in enumerate(stack) if o.name == "head"), 0)
            if at:
                close(at)
        if name in _BLOCK and name not in _NARROW_HOLDS:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in _NARROW or stack[k].name in ("foreignobject", "annotation-xml")), 0)
            if at and stack[at].name in _NARROW:
                close(at)
        if name in _CLOSES:
            stop = _HOLDS.get(name, _CONTAINERS)
            at = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in stop:
                    break
                if stack[k].name in _CLOSES[name]:
                    at = k
            close(at)
        elif name in _BLOCK and name not in _VOID:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "p" or stack[k].name in _CONTAINERS), 0)
            if at and stack[at].name == "p":
                close(at)
        names = [(k.lower(), x.strip("\"'")) for k, x in _NAMES.findall(m["attributes"])] if m["attributes"] else []
        named = " ".join(x for _, x in names)
        top = stack[-1]
        role = f"{name}.{re.sub(r'[0-9]+', 'N', '.'.join(sorted(named.split())))}" if named else name
        path = f"{top.path}/{role}"
        tags[path] += 1
        if name in _BLOCK:
            if name == "br":
                say(" ")
                continue
            flush()
        if name in _VOID:
            continue
        inside = name in ("article", "main")
        own, causes = None, top.causes
        if inside:
            # an article of the readers' comments is away with them, one in an aside unless that was left open; else it stands for itself
            causes = causes if any(c.kind == "readers" for c in causes) else tuple(_Cause("aside", c.tag, c.around or c) for c in causes if c.kind == "aside")
            if name == "article" and (hit := _named_away(names, False, _TEASERS)):
                own = _Cause("readers" if hit[0] in _READERS else "name", "")
        elif name in _AWAY and not (name == "header" and top.article):
            own = _Cause("aside" if name in ("aside", "footer") else "tag", name)
        elif name not in ("html", "body"):
            if top.article and name in _SECTIONS:
                names = [x for x in names if x[0] != "id"]
            if (hit := _named_away(names, top.article)) and not (top.article and name in _TEXTS and hit[0] in _CALLOUTS):
                own = _Cause("readers" if hit[0] in _READERS else "aside" if hit[0] in _ASIDES else "name" if hit[1] else "part", "")
        stack.append(_Open(name, path, (*causes, own) if own else causes, top.article or inside, own))
        if m["attributes"].endswith("/") and name not in _BLOCK:
            stack.pop()
    say(page[done:])
    flush()
    return _judged(blocks), tags


def _judged(read: list[tuple[_Open, str]]) -> list[Block]:
    """The blocks, away if a cause is left. An aside left open does not hold an article; a loose cause does not hold where it has most
    of the text that no firm cause has; nor, where nothing remains, do forms and what was left open, nor whole names with much text."""
    free = {c for o, _ in read for c in o.causes if c.around and c.left_open()}
    for may, least in ((_Cause.loose, _MOST), (lambda c: c.tag == "form" or c.left_open(), 1), (lambda c: c.kind == "name" or c.loose(), _MOST)):
        weights: Counter = Counter()
        total = 0
        for o, text in read:
            if all(c in free or may(c) for c in o.causes):
                total += len(text)
                for c in o.causes:
                    weights[c] += len(text)
        free |= {c for c, n in weights.items() if n >= least and 2 * n > total}
        blocks = [Block(o.path, any(c not in free for c in o.causes), o.article, text) for o, text in read]
        if not all(b.away for b in blocks):
            break
    return blocks


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


_TOKENS = T.StructType([T.StructField("host", T.StringType()), T.StructField("token", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("mark", T.LongType())])
#: With ``slot``: of words, the slot they fill; of a slot, its path.
_SLOTTED = T.StructType([*_TOKENS.fields, T.StructField("slot", T.LongType())])
TAG, WORDS, ARTICLE, SLOT = 0, 1, 2, 3


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, token, kind, n (times on the page), mark (of the page and n) and slot from (host, page, html) rows.
    A slot is a path and the place of the text among the page's texts of that path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for host, page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks, tags = read_page(html or "")
                found = [(_digest("tag", p), ARTICLE if re.search(r"/(?:article|main)(?:\.[^/]*)?$", p) else TAG, n, None) for p, n in tags.items()]
                places, words, first = Counter(), Counter(), {}
                for b in blocks:
                    if not b.away and not b.article:
                        slot = _digest("slot", b.path, str(places[b.path]))
                        places[b.path] += 1
                        words[b.path, b.text] += 1
                        first.setdefault((b.path, b.text), slot)
                        found.append((slot, SLOT, 1, _digest("path", b.path)))
                found += [(_digest("words", *w), WORDS, n, first[w]) for w, n in words.items()]
                for token, kind, n, slot in found:
                    for c, v in zip(out, (host, token, kind, n, _digest("at", str(page), str(n)), slot), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], _SLOTTED.names)

    return pages.select("host", "page", "html").mapInArrow(read, _SLOTTED)


def _classes(tokens: DataFrame, support: int) -> DataFrame:
    """host, n_pages, n_total, vector (checksum), class_size and members: a row a class on ``support`` pages. A
    member is on every page of its class, so a row is at most one page's tokens."""
    slot = F.col("slot") if "slot" in tokens.columns else F.lit(None).cast("long")
    vectors = tokens.groupBy("host", "token", "kind").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_total"), F.struct(F.sum(F.col("mark").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned("mark", 32)).alias("high")).alias("vector"), F.min(slot).alias("slot"), F.max(slot).alias("last"))
    vectors = vectors.where(F.col("n_pages") >= support)
    member = F.struct("token", "kind", F.when(F.col("slot") == F.col("last"), F.col("slot")).alias("slot"))  # words that move fill no slot
    return vectors.groupBy("host", "n_pages", "n_total", "vector").agg(F.count(F.lit(1)).alias("class_size"), F.collect_list(member).alias("members"))


def equivalence_classes(tokens: DataFrame, support: int = SUPPORT) -> DataFrame:
    """host, token, kind, slot, vector, n_pages, n_total and class_size for tokens in valid classes."""
    valid = _classes(tokens, support).where(F.col("class_size") >= TOKENS)
    return valid.select("host", F.inline("members"), "vector", "n_pages", "n_total", "class_size")


def templates(tokens: DataFrame, support: int = SUPPORT) -> DataFrame:
    """host, fixed and varying, one row a host. ``fixed``: words outside articles in a valid class with the slot that
    they fill, and the root class's. ``varying``: paths of slots whose words vary, for hosts with article tags. A row
    is bounded by the host's distinct slots and one page's words."""
    members = lambda kind: F.filter("members", lambda x: x["kind"] == kind)
    slots, words = F.col("slots"), F.col("words")
    c = _classes(tokens, support).select("host", "n_pages", "n_total", "class_size", F.size(members(ARTICLE)).alias("articles"), members(SLOT).alias("slots"), members(WORDS).alias("words"))
    held = F.when(F.col("class_size") >= TOKENS, F.filter(words, lambda w: F.exists(slots, lambda x: x["token"] == w["slot"]))).otherwise(F.filter(words, lambda w: F.lit(False)))
    c = c.withColumn("held", held)
    c = c.withColumn("varying", F.array_distinct(F.transform(F.filter(slots, lambda x: ~F.exists("held", lambda w: w["slot"] == x["token"])), lambda x: x["slot"])))
    pages = c.groupBy("host").agg(F.max("n_pages").alias("host_pages"), F.max(F.col("articles") > 0).alias("in_article"))  # some tag is on every page
    told = c.where((F.size("words") > 0) | (F.size("varying") > 0)).join(pages, "host")
    root = (F.col("n_pages") == F.col("host_pages")) & (F.col("n_total") == F.col("n_pages"))
    told = told.select("host", F.transform(F.when(root, words).otherwise(F.col("held")), lambda w: w["token"]).alias("fixed"), F.when(F.col("in_article"), F.col("varying")).alias("varying"))
    # one by one, so that partial sums hold each path once
    told = told.select("host", F.explode(F.concat(F.transform("fixed", lambda x: F.struct(x.alias("fixed"), F.lit(None).cast("long").alias("varying"))), F.transform(F.coalesce("varying", F.array().cast("array<long>")), lambda x: F.struct(F.lit(None).cast("long").alias("fixed"), x.alias("varying"))))).alias("x"))
    return told.groupBy("host").agg(F.collect_set("x.fixed").alias("fixed"), F.collect_set("x.varying").alias("varying"))


def chosen(blocks: list[Block], fixed: set[int], varying: set[int]) -> list[Block]:
    """The blocks that are text, of those not away."""
    rest = [b for b in blocks if not b.article and (not fixed or _digest("words", b.path, b.text) not in fixed)]
    inside = sum(len(b.text) for b in blocks if b.article)
    if inside and sum(len(b.text) for b in rest) <= inside:
        rest = [b for b in rest if _digest("path", b.path) in varying] if varying else []
    kept = set(map(id, rest))
    return [b for b in blocks if b.article or id(b) in kept] or blocks


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", support: int = SUPPORT) -> DataFrame:
    """row and text for every page."""
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in pages.columns if c != html))
    p = pages.select(row.alias("row"), host_of(F.col(f"`{url}`").cast("string")).alias("host"), F.col(f"`{page_id}`").cast("string").alias("page"), F.col(f"`{html}`").cast("string").alias("html"))
    # written out, so that the join below stands alone: it may be broadcast by size or have a hot host split
    deduced = materialise(templates(page_tokens(p.where("host <> ''")), support))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, fixed, varying in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                blocks = [b for b in read_page(html or "")[0] if not b.away]
                texts.append(" ".join(b.text for b in chosen(blocks, set(fixed or ()), set(varying or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    joined = p.join(deduced, "host", "left").select("row", "html", "fixed", "varying")
    return joined.mapInArrow(cut, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))

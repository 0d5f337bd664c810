"""Operator 6, main text of HTML pages.

Mark-up decides what it can: elements that are boilerplate by tag or role go, by a whole class or id name too, and where
a page marks its main part (``article``, ``main``) all outside of it goes; a form that holds the main part stays. Inside
the main part only names that mean nothing else (adverts, reader comments) are enough, or two names together. What is left in doubt - all blocks of
a page that marks no main part, blocks whose class or id only begins like boilerplate ("related-work"), and those inside
the main part with a name that an article may use, too ("social") - goes through the host suffix array: the token streams of a host's pages are cut into repeated and unique runs by distributed prefix doubling
(see ``repeats``), runs of at least ``LONG`` tokens that occur on another page of the host are removed, and the unique
runs are kept. A page that would lose everything is a copy and not boilerplate; it keeps its text. (The suffix array
alone can't give the right text: menus and adverts may differ on each page, and articles of copied pages repeat. The
README has figures.)

Null html is empty; a null url is the host "". Rows equal in id, url and html are one page; rows of one id are told apart.
Broken and cut mark-up is read as far as it goes; character references are decoded as HTML5 does, also without their
semicolon. Pages of any length are read in time linear in it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_of, key_of, text_batches, stash
from .repeats import outside, repeated_runs

LONG = 8  # tokens; a power of two
MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
RAW = frozenset("script style noscript template title textarea iframe svg math object xmp".split())
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
DROPPED = frozenset("nav footer aside form button select menu dialog head".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_ITSELF = frozenset("p li td th tr option dt dd".split())
#: Names that mean boilerplate wherever they stand, and names that do outside of a main part.
CLEAR = frozenset("ad ads adv advert adverts advertisement advertising sponsored disqus comments navbar menubar breadcrumbs cookies gdpr newsletter masthead".split())
WORDS = (
    "banner sponsor promo promotion cookie consent notice notices alert sidebar menu nav navigation breadcrumb share sharing social related recommended "
    "popup modal subscribe comment replies footer header login signup search toolbar pagination pager widget skip"
)
BOILER = CLEAR | frozenset(WORDS.split())
MAIN = re.compile(r"<(?:article|main)\b|role=[\"']?main\b", re.I)
FORM_END = re.compile(r"</form\b", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


SURE, DOUBTFUL = 2, 1


def _boiler(tag: str, attributes: str, inside: bool) -> int:
    """SURE, DOUBTFUL or 0."""
    if tag in DROPPED or (tag == "header" and not inside):
        return SURE
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)) or (name == "role" and value in ROLES):
            return SURE
        if name in ("class", "id"):
            named = BOILER.intersection(value.split())
            if named and (not inside or len(named) > 1 or not CLEAR.isdisjoint(named)):
                return SURE
            if not BOILER.isdisjoint(part for whole in value.split() for part in re.split(r"[-_]+", whole)):
                found = DOUBTFUL
    return found


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """start, end, closing, name ("" for comments and the like) and attributes of each piece of mark-up, in one pass. A tag
    ends at the first > that stands in no quoted value; a quote that is never closed quotes nothing, and a tag that never
    ends takes the rest of the page. Elements of raw text are one piece with all that is in them."""
    at, size = 0, len(page)
    while m := MARK.search(page, at):
        start, at = m.start(), m.end()
        if page.startswith("<!--", start):
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            yield start, at, False, "", ""
        elif page[start + 1] in "!?":
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            yield start, at, False, "", ""
        else:
            name = NAME.match(page, at - 1)
            at = name.end()
            while (stop := STOP.search(page, at)) and stop[0] != ">":
                close = page.find(stop[0], stop.end()) if page[at : stop.start()].rstrip()[-1:] == "=" else -1
                at = close + 1 if close >= 0 else stop.end()
            end = stop.start() if stop else size
            at = min(end + 1, size)
            closing, tag, attributes = page[start + 1] == "/", name[0].lower(), page[name.end() : end]
            if tag in RAW and not closing and not attributes.rstrip().endswith("/"):
                last = RAW_END[tag].search(page, at)
                at = last.end() if last else size
            yield start, at, closing, tag, attributes


def parse(page: str) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]], bool]:
    """Blocks (text, doubtful) inside the main part, blocks outside any boilerplate, and whether a main part is marked."""
    inner: list[tuple[str, bool]] = []
    outer: list[tuple[str, bool]] = []
    piece: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, boilerplate, inside the main part
    open_tags: Counter[str] = Counter()
    boiler, inside, marked, at = 0, False, False, 0

    def flush() -> None:
        if piece:
            text = " ".join("".join(piece).split())
            piece.clear()
            if text:
                outer.append((text, boiler == DOUBTFUL))
                if inside:
                    inner.append((text, boiler == DOUBTFUL))

    places: list[list[int]] = []  # of main parts and of ends of forms, found when the first form is met

    def holds_main(start: int) -> bool:
        if not places:
            places.extend([m.start() for m in mark.finditer(page)] for mark in (MAIN, FORM_END))
        first = [at[i] if (i := bisect_left(at, start)) < len(at) else len(page) for at in places]
        return first[0] < first[1]

    for start, end, closing, tag, attributes in tags(page):
        if boiler != SURE:
            piece.append(entities.unescape(page[at:start]))  # each piece by itself: mark-up ends a reference
        at = end
        if not tag or (tag in RAW and not closing):
            continue
        alone = attributes.rstrip().endswith("/")
        if closing:
            if tag not in INLINE or (stack and stack[-1][0] == tag):
                flush()
                if open_tags[tag]:
                    while True:
                        gone = stack.pop()[0]
                        open_tags[gone] -= 1
                        if gone == tag:
                            break
        elif tag in VOID:
            if tag in ("br", "hr"):
                flush()
        else:
            kind = 0 if tag == "form" and holds_main(end) else _boiler(tag, attributes, inside)
            if tag in INLINE and not kind:
                continue
            flush()
            if tag in CLOSED_BY_ITSELF and stack and stack[-1][0] == tag:
                open_tags[stack.pop()[0]] -= 1
                boiler, inside = stack[-1][1:] if stack else (0, False)
            main = tag in ("article", "main") or 'role="main"' in attributes
            marked |= main and max(boiler, kind) != SURE
            if not alone:
                stack.append((tag, max(boiler, kind), inside or main))
                open_tags[tag] += 1
        boiler, inside = stack[-1][1:] if stack else (0, False)
    if boiler != SURE:
        piece.append(entities.unescape(page[at:]))
    flush()
    return inner, outer, marked


def _parsed(pages: DataFrame) -> DataFrame:
    """d, h, url, text of the pages without doubt; of the others tokens, with those that are in doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, tokens, doubts = [], [], []
            for page in b.column(3).to_pylist():
                inner, outer, marked = parse(page or "")
                blocks = inner if marked else [(text, True) for text, _ in outer]
                unsure = any(doubt for _, doubt in blocks)
                texts.append(None if unsure else " ".join([text for text, _ in blocks]))
                words = [(t, doubt) for text, doubt in blocks for t in text.split(" ")] if unsure else []
                tokens.append([t for t, _ in words] if unsure else None)
                doubts.append([doubt for _, doubt in words] if unsure else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array(doubts, pa.list_(pa.bool_()))], ["d", "h", "url", "text", "tokens", "doubts"])

    text_batches(pages.sparkSession)
    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    return pages.select(key_of("page_id").alias("d"), F.xxhash64(url, page).alias("h"), url.alias("url"), page.alias("html")).mapInArrow(run, "d long, h long, url string, text string, tokens array<string>, doubts array<boolean>")


def unique_runs(unsure: DataFrame) -> DataFrame:
    """d, h, url, text: without the doubtful tokens that stand in a run of LONG tokens on another page of the host, too."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))
    marked = F.posexplode(F.arrays_zip("tokens", "doubts")).alias("i", "x")
    tokens = unsure.select("d", "h", host.alias("host"), marked).where("x.doubts").select("d", "h", "host", "i", F.col("x.tokens").alias("t"))
    symbols = tokens.select("d", "h", "i", F.col("i").alias("l"), F.xxhash64("host", "t").alias("a"), F.xxhash64(F.reverse("t"), "host").alias("b"), F.lit(1).alias("n"), F.struct("d", "h").alias("page"))
    runs = repeated_runs(stash(symbols, "page-tokens"), LONG, across="page", all_copies=True)
    runs = runs.groupBy("d", "h").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    joined = unsure.join(stash(runs, "page-runs"), ["d", "h"], "left")
    kept = outside(F.col("tokens"), F.col("runs"))
    left = F.when(F.col("runs").isNull() | (F.size(kept) == 0), F.col("tokens")).otherwise(kept)
    return joined.select("d", "h", "url", F.array_join(left, " ").alias("text"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page row."""
    parsed = stash(_parsed(pages), "pages")
    sure = parsed.where("tokens is null").select("d", "h", "url", "text")
    unsure = parsed.where("tokens is not null")
    rows = sure if unsure.isEmpty() else sure.unionByName(unique_runs(unsure))
    return rows.select(id_of("d").alias("page_id"), "url", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))

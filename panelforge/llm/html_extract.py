"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.llm.storage import small_batches

#: A tag from its name on, quotes closed. Possessive: what was read is never read again.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:_-]*")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|(?=[\s/]|$))""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
LAYOUT = re.compile(r"(?:has|with|no|without)(?:[-_][\w-]*|[A-Z]\w*)")
PUNCTUATION = re.compile(r"[.,;:!?…。，]")

# Fixed values of the HTML standard and of common page markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("svg canvas object template noscript select datalist audio video annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
ENDS_SELF = frozenset("li dd dt option tr td th".split())
#: Elements that say nothing of the text in them.
WRAPPERS = frozenset(" div section center body html span".split(" "))
APART_TAGS = frozenset("head nav header footer aside button dialog menu fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
APART_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond discussion disqus pagination pager toolbar copyright disclaimer paywall".split())
APART_WEAK = frozenset("share sharing social related recommended recommendations trending header head side form widget legal meta tags search".split())
MAIN_WORDS = frozenset("article entry post content story main body text page".split())

#: Deeper elements count as part of the one at this depth, as in browsers.
DEEPEST = 512
#: What of a path's ratio reaches the paths one level below it.
DECAY = 0.7
LEAST = 1.0


@dataclass
class _Open:
    tag: str
    path: int
    hard: bool = False  # set apart by its tag, role or being hidden
    marked: bool = False  # set apart by its class or id
    doubt: int = -1  # an element in an article whose name is doubtful: its text decides
    main: bool = False
    soft: bool = False  # an article in an element that is set apart by its class or id alone
    named: int = -1  # the nearest element named as content
    form: bool = False  # in a form


@dataclass
class Block:
    """A run of text between block tags, with what its element says of it."""

    at: _Open
    text: str
    linked: int
    marks: int


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0)])
    count: Counter = field(default_factory=Counter)
    parents: list[int] = field(default_factory=lambda: [0])
    labels: list[str] = field(default_factory=lambda: [""])
    known: dict[tuple[int, str], int] = field(default_factory=dict)
    holds: list[bool] = field(default_factory=list)  # of each element named as content, whether an article is in it
    mains: set[int] = field(default_factory=set)  # paths that are an article or main element
    doubts: int = 0
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False
    unseen: list[str] = field(default_factory=list)
    unseen_count: Counter = field(default_factory=Counter)

    def text(self, raw: str) -> None:
        if raw and not self.unseen:
            self.pieces.append(raw)
            if self.in_link:
                self.linked += len(raw)

    def close(self) -> None:
        """End the current block; references are decoded once its inline parts are together."""
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append(Block(self.stack[-1], text, min(self.linked, len(text)), len(PUNCTUATION.findall(text))))
            self.pieces, self.linked = [], 0

    def path(self, above: int, label: str) -> int:
        key = (above, label)
        if key not in self.known:
            self.known[key] = len(self.parents)
            self.parents.append(above)
            self.labels.append(label)
        return self.known[key]

    def start(self, tag: str, attributes: str) -> None:
        closed = attributes.endswith("/")
        if self.unseen:
            if not closed and tag not in VOID:
                self.unseen.append(tag)
                self.unseen_count[tag] += 1
            return
        if tag in UNSEEN:
            if not closed:
                self.unseen, self.unseen_count = [tag], Counter([tag])
            return
        if tag == "a":
            self.in_link = True
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in INLINE:
            return
        self.close()
        if tag in ENDS_P:
            self.pop({"p"}, stop=frozenset({"button", "td", "th", "table"}))
        if tag in ENDS_SELF:
            self.pop({tag}, stop=frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag in VOID or len(self.stack) > DEEPEST:
            return
        self.stack.append(self.opened(tag, attributes))
        self.count[tag] += 1

    def opened(self, tag: str, attributes: str) -> _Open:
        above = self.stack[-1]
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = [frozenset(w.lower() for w in WORD.findall(n)) for n in f"{found.get('class', '')} {found.get('id', '')}".split() if not LAYOUT.fullmatch(n)]
        words = frozenset().union(*names)
        content = any(n & MAIN_WORDS and not n & (APART_WORDS | APART_WEAK) for n in names) and tag not in ("html", "body")
        role = found.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
        hard = (tag in APART_TAGS and not (tag == "header" and above.main)) or role in APART_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        strong, weak = bool(words & APART_WORDS), bool(words & APART_WEAK) and not content
        if words & {"header", "head"} and words & MAIN_WORDS and not words & (APART_WEAK - {"header", "head"}):
            weak = False
        judged = tag not in ("html", "body")
        bare = judged and tag not in ("article", "main")
        form = tag == "form" or role == "form"
        doubt = judged and weak and not strong and above.main
        marked = judged and (strong or (weak and not doubt))
        out = _Open(tag, self.path(above.path, tag + "".join("." + w for w in sorted(words))), above.hard or (bare and hard), above.marked or (bare and marked), above.doubt, above.main or main, False, above.named, above.form or form)
        out.soft = not (hard or marked or above.hard) and (above.soft or (main and above.marked))
        if doubt:
            out.doubt, self.doubts = self.doubts, self.doubts + 1
        if content:
            out.named = len(self.holds)
            self.holds.append(False)
        if main:
            self.mains.add(out.path)
            for o in reversed(self.stack):
                if o.named >= 0:
                    if self.holds[o.named]:
                        break
                    self.holds[o.named] = True
        return out

    def end(self, tag: str) -> None:
        if self.unseen:
            if self.unseen_count[tag]:
                while self.unseen:
                    last = self.unseen.pop()
                    self.unseen_count[last] -= 1
                    if last == tag:
                        break
                return
            if not self.count[tag]:
                return
            self.unseen = []  # its end is missing: the element around it ends
        if tag == "a":
            self.in_link = False
        if tag in INLINE or tag == "br":
            return
        self.close()
        self.pop({tag})

    def pop(self, tags: set[str], stop: frozenset[str] = frozenset()) -> None:
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                for o in self.stack[k:]:
                    self.count[o.tag] -= 1
                del self.stack[k:]
                return
            if self.stack[k].tag in stop:
                return


def parsed(page: str) -> _Page:
    """The text blocks of a page in order, each with its root-to-leaf tag path. Inline tags are no part of it.

    Every character is read a bounded number of times: quotes that are never closed are no quotes from there on, and
    an end that was not found once is not looked for again.
    """
    out, at, quoted = _Page(), 0, True
    missing: set[str] = set()
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if lt > at:
                out.text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            continue
        m = NAME.match(page, lt + 1 + (nxt == "/"))
        if m is None:
            out.text(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            out.text(page[at:lt])
        rest = REST.match(page, m.end()) if quoted else None
        if rest is not None:
            attributes, at = rest[1], rest.end()
        else:
            quoted = False
            end = page.find(">", m.end())
            if end < 0:
                at = len(page)
                break
            attributes, at = page[m.end() : end], end + 1
        tag = m[0].lower()
        if nxt == "/":
            out.end(tag)
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = None if tag in missing else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                missing.add(tag)
                at = len(page) if tag in ("script", "style") else at
                continue
            close = page.find(">", end.end())
            at = len(page) if close < 0 else close + 1
            continue
        out.start(tag, attributes)
    out.text(page[at:])
    out.close()
    return out


def weights(page: _Page) -> np.ndarray:
    """Which blocks may be content at all, by markup.

    Out are blocks in elements set apart (menus, headers, footers, asides, notices, adverts, forms, comments; a form that holds
    most of the page's text is a wrapper and sets nothing apart) and, where
    an article or main element has text, blocks outside both these and elements named as content without an article in
    them. If all of the articles' text is in wrappers set apart by class or id alone, it may be content nevertheless. In an
    article, an element of a doubtful name (share, related, ...) is content if it reads as the rest does: mostly unlinked,
    with punctuation, and at least half as long a block.
    """
    b = page.blocks
    apart = np.array([x.at.hard or x.at.marked for x in b])
    main = np.array([x.at.main for x in b])
    form = np.array([x.at.form for x in b])
    plain_text = np.array([0 if a else len(x.text) - x.linked for x, a in zip(b, apart, strict=True)])
    if plain_text[form].sum() <= plain_text[~form].sum():
        apart |= form
    if not (main & ~apart).any():
        apart &= ~np.array([x.at.soft and not x.at.hard for x in b])
    inside = main | np.array([x.at.named >= 0 and not page.holds[x.at.named] for x in b])
    out = ~apart & (inside if (main & ~apart).any() else True)
    doubt = np.array([x.at.doubt for x in b])
    length = np.array([len(x.text) - x.linked for x in b], float)
    whole, marks = np.array([len(x.text) for x in b], float), np.array([x.marks for x in b])
    plain = out & (doubt < 0)
    usual = length[plain].mean() if plain.any() else 0.0
    for d in np.unique(doubt[doubt >= 0]).tolist():
        own = doubt == d
        if length[own].sum() < 0.7 * whole[own].sum() or not marks[own].any() or length[own].mean() < usual / 2:
            out &= ~own
    return out


def path_scores(page: _Page) -> np.ndarray:
    """For each block the smoothed ratio of its tag path.

    A path's text ratio is its unlinked text length, its punctuation ratio its punctuation marks, each per node of the
    path; the two are fused by their geometric mean. Ratios are smoothed along the tree: a path counts for no less than
    DECAY times the path above it with all that is below it, so headings and list items go with the text around them;
    an article or main element is not lifted by what is around it.
    Paths of three nodes or more count by the share of their text that is no link, headings excepted. Blocks that markup
    rules out (weights) count 0 and add nothing to the paths above them.
    """
    b, n = page.blocks, len(page.parents)
    may = weights(page)
    at = np.array([x.at.path for x in b])
    whole = np.array([len(x.text) for x in b], float)
    length = whole - np.array([x.linked for x in b])
    marks = np.array([x.marks for x in b], float)
    sums = np.stack([np.bincount(at[may], weights=w[may], minlength=n) for w in (np.ones(len(b)), length, marks, whole)])
    below = sums.copy()
    for p in range(n - 1, 0, -1):  # parents are numbered before their children
        below[:, page.parents[p]] += below[:, p]
    fused = lambda s: np.sqrt((s[1] / np.maximum(s[0], 1) + LEAST) * (1 + s[2] / np.maximum(s[0], 1)))
    own, around = fused(sums), fused(below)
    smooth = np.zeros(n)
    for p in range(n):
        lift = 0.0 if p == 0 or p in page.mains else DECAY * around[page.parents[p]]
        smooth[p], around[p] = max(own[p], lift), max(around[p], lift)
    heading = np.array([label.split(".")[0] in HEADINGS for label in page.labels])
    unlinked = np.where((sums[0] < 3) | heading, 1.0, sums[1] / np.maximum(sums[3], 1))
    return np.where(may, (smooth * unlinked)[at], 0.0)


def chosen(page: _Page) -> np.ndarray:
    """Which blocks are content: those whose path score reaches the standard deviation of the page's scores, or a quarter of
    the best one if that is less.

    In an article or main element that has such a block, its other blocks are content too (cells, captions, short items),
    but for paths of three nodes or more that are mostly links. Where no such element is, nothing but its own text speaks
    for a block that stands alone: what is all link goes, and so does a wrapper's line without punctuation whose own ratio
    does not reach the threshold.
    """
    b = page.blocks
    score = path_scores(page)
    least = min(float(score.std()), float(score.max()) / 4)
    good = (score > 0) & (score >= least)
    at = np.array([x.at.path for x in b])
    whole, linked, marks = (np.array(v, float) for v in ([len(x.text) for x in b], [x.linked for x in b], [x.marks for x in b]))
    sums = [np.bincount(at, weights=w, minlength=len(page.parents)) for w in (np.ones(len(b)), whole - linked, marks, whole)]
    heading = np.array([x.at.tag in HEADINGS for x in b])
    around = np.zeros(len(page.parents), int)  # the nearest article or main path, 0 if there is none
    for p in range(1, len(page.parents)):
        around[p] = p if p in page.mains else around[page.parents[p]]
    if not around.any():
        alone = np.array([x.at.tag in WRAPPERS for x in b]) & (marks == 0) & (np.sqrt(sums[1] / np.maximum(sums[0], 1) + LEAST)[at] < least)
        return good & (heading | ((linked < whole) & ~alone))
    own = (sums[0][at] < 3) | heading | (sums[1] >= 0.3 * sums[3])[at]
    held = np.isin(around[at], np.unique(around[at][good])) & (around[at] > 0)
    return good | (held & own & (score > 0))


def main_text(page: str | None) -> str:
    """The main text of a page (see chosen); empty for null, empty or text-free pages."""
    found = parsed(page or "")
    if not found.blocks:
        return ""
    return " ".join(b.text for b, ok in zip(found.blocks, chosen(found), strict=True) if ok)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html_col, with out_col (string, empty if there is none) and n_chars (its code points).

    One row for every input row, nulls and repeated rows too. Columns named like the two results are replaced.
    """
    small_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    base = pages.select(*names, html_col)
    out = T.StructType([*pages.select(*names).schema.fields, T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out.names)

    return base.mapInArrow(scan, out)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

"""Main text of web pages by scoring the tree of their elements.

A page is read into a tree. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out by their element or by the
words of their class, id and role. Each paragraph of the rest passes points for its
length and its commas to its parent, half of them to the grandparent, a third to
the next, and so on; a container's points shrink with the share of its text that is
in links. From the best container the way goes up to its article or main, or as long as
little but headings and paragraphs are added. The whole of this is kept, and those of its
siblings that score well or are prose themselves; without an article or main, lists of
links are left out of it.

A name leaves a block out if one of its words is for what is left out. In an article or
in what is named as content, it must name just that: a section on ``login-security``
stays, ``login-box`` and ``article-comments`` go. An inline element with such a name is left out only where
its block has nothing else.

The text is that of the kept blocks in page order, joined by line feeds. Character
references are decoded and white space inside a block becomes one space. A page of
plain text is one block. A null or empty page, or one with nothing left, has an
empty text. Elements left open, stray end tags, broken quotes and deep nesting are
read as far as they go, in time in proportion to the page's length. Repeated rows and null ids are pages like any other; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by what they do here.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset(
    "head script style noscript template title nav header footer aside form button select "
    "textarea input iframe object embed svg canvas annotation annotation-xml audio video map "
    "dialog menu xmp noembed noframes datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote li dd td th dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup caption legend summary".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Any other element ends a head whose end tag is left out.
IN_HEAD = frozenset(
    "base basefont bgsound head link meta noframes noscript script style template title".split()
)
# An element of these ends an open one of the second list, inside the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}

# Words of classes, ids and roles.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination paywall popup promo promoted promotion "
    "related recommended replies respond share sharing sidebar signup skip social sponsor "
    "sponsored sponsors subscribe subscription toolbar widget widgets complementary contentinfo "
    "search alert".split()
)
READER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense comment comments commentlist "
    "consent cookie cookies disclaimer discussion disqus gdpr login newsletter paywall replies "
    "respond signup subscribe subscription".split()
)
# Words that beside one of the above say no more than where or what it is.
PLAIN_WORDS = frozenset(
    "area author bar block body bottom box btn button buttons card cards col column container "
    "content count date entry first footer form grid group head heading hidden holder icon icons "
    "inner item items last left link links list main meta mini mobile module name panel post posts "
    "primary region reply results right row secondary section site slot small stories sub text "
    "thread title top unit user wrap wrapper articles left page sticky fixed inline".split()
)
# How bad a name is: one of its words is bad, the word for what it names is, or it is for
# what readers or the site's owner say beside the article.
PARTLY, NAMED, READERS = 1, 2, 3
GOOD_WORDS = frozenset("article body content entry hentry main page post story text".split())
NEGATIONS = frozenset("has have no with without is js non".split())
MAIN_TAGS = frozenset("article main".split())
NEVER_BAD = frozenset("html body article main".split())

MAIN_ELEMENT = 50.0
GOOD_NAME = 25.0
# A sibling is kept from this share of the best score on.
SIBLING_SHARE = 0.2
# Of the text that an element adds to the best container so much must be prose.
PROSE_SHARE = 0.75
SHORT_PARAGRAPH = 25
# A list with so many links, and so much of its text in them, is a menu if no article
# or main has it.
LEAST_LINKS = 3
LINK_LIST = 0.8

# Nothing here gives back what it took, so a page is read in time in proportion.
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_TAG_REST = re.compile(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")
_COMMENT_END = re.compile(r"--!?>")
_SPECIAL = re.compile(r"[\"'>]")
# References to characters by numbers longer than any has.
_ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
_TOO_LONG = re.compile(r"&#(?:[0-9]{9,}+|[xX][0-9a-fA-F]{9,}+);?")
_ATTRIBUTE = re.compile(
    r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'"
)
# Searched in the page itself: lower case may have other positions.
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.ASCII | re.IGNORECASE) for tag in RAW}
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _badness(words: list[str]) -> int:
    """How bad the words of one name are."""
    said = []
    for word, before, after in zip(words, [None, *words], [*words[1:], None]):
        if before in NEGATIONS or after == "free":
            break
        said.append(word)
    if BAD_WORDS.isdisjoint(said):
        return 0
    # What a compound names is its last word that says more than where it stands.
    named = next(w for w in reversed(said) if w in BAD_WORDS or w not in PLAIN_WORDS)
    if named not in BAD_WORDS:
        return PARTLY
    return NAMED if READER_WORDS.isdisjoint(said) else READERS


def _names(attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is hidden, how bad its names are, and whether one is good."""
    hidden = good = False
    bad = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "style":
            gone = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
            hidden = hidden or bool(gone)
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif name == "itemprop":
            good = good or value.lower() == "articlebody"
        elif name in ("class", "id", "role"):
            for part in unescape(value).split():
                # Part of another name, as in overflow-hidden, it does not hide.
                hidden = hidden or (name == "class" and part.lower() == "hidden")
                words = [w.lower() for w in _NAME_WORDS.findall(part)]
                bad = max(bad, _badness(words))
                good = good or not GOOD_WORDS.isdisjoint(words)
    return hidden, bad, good


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = _TOO_LONG.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return unescape(text)


class _TagEnds:
    """Where the tag ends that begins at a place, if quotes are closed on the page.

    ``>`` in quotes does not end a tag. Ends are worked out from the end of the page
    backwards, for a place outside quotes and inside those of either kind.
    """

    def __init__(self, html: str, at: int):
        self._places = [m.start() for m in _SPECIAL.finditer(html, at)]
        outside = double = single = -1
        self._ends = [-1]
        for place in reversed(self._places):
            if html[place] == ">":
                outside = place + 1
            elif html[place] == '"':
                outside, double = double, outside
            else:
                outside, single = single, outside
            self._ends.append(outside)
        self._ends.reverse()

    def after(self, at: int) -> int:
        """The end for a place outside quotes; -1 if there is none."""
        return self._ends[bisect_left(self._places, at)]


class Page:
    """The elements of a page, parents before children, and its blocks of text."""

    def __init__(self, html: str):
        self.tags: list[str] = ["html"]
        self.parents: list[int] = [-1]
        self.weights: list[float] = [0.0]
        self.left_out: list[bool] = [False]
        # Blocks with bad names, which are left out if the article is elsewhere.
        self.bad: list[int] = [0]
        # Articles that are named as what readers say.
        self.readers: set[int] = set()
        # Inline elements with bad names, and what is in them.
        self.beside: list[bool] = [False]
        # Element, text, characters in links, number of links.
        self.blocks: list[tuple[int, str, int, int]] = []
        self._articles: list[int] | None = None
        self._stack = [0]
        # Depths in the stack of the open elements of each name, and of all blocks.
        self._open: dict[str, list[int]] = {}
        self._open_blocks: list[int] = []
        self._pieces: list[str] = []
        self._linked = self._links = 0
        self._only_beside = True
        self._has_body = False
        self._read(html)
        if any(self.bad):
            self._leave_out_bad()

    def _leave_out_bad(self) -> None:
        """Leave out elements with bad names but those around the page's article.

        Such are those that hold most of the prose of all articles and mains or, on a
        page without one, most of the prose. Comments, adverts and notices must hold a
        main or, where no article is outside, one that is large against all outside.
        """
        n = len(self.tags)
        points, largest, outside = [0.0] * n, [0.0] * n, 0.0
        bad_above, in_article = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parents[i]
            # In an article only a name for what is left out counts.
            if in_article[up] and self.bad[i] == PARTLY:
                self.bad[i] = 0
            bad_above[i] = bad_above[up] or self.bad[i] > 0
            is_article = self.tags[i] in MAIN_TAGS and i not in self.readers
            in_article[i] = not bad_above[i] and (in_article[up] or is_article or self.weights[i] > 0)
        for at, text, *_ in self.blocks:
            own = _points(self.tags[at], text)
            points[at] += own
            outside += 0.0 if bad_above[at] else own
        alone = not any(
            self.tags[i] in MAIN_TAGS and i not in self.readers and not bad_above[i]
            for i in range(1, n)
        )
        articles, mains = [0.0] * n, [False] * n
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            points[up] += points[i]
            if self.tags[i] in MAIN_TAGS and i not in self.readers:
                articles[i] = largest[i] = points[i]
                mains[i] |= self.tags[i] == "main" and points[i] > 0
            spared = mains[i] or (alone and largest[i] > 2 * outside)
            if self.bad[i] != READERS or spared:
                articles[up] += articles[i]
                largest[up] = max(largest[up], largest[i])
                mains[up] |= mains[i]
            else:
                articles[i] = 0.0
        for i in range(1, n):
            out = self.left_out[i] or self.left_out[self.parents[i]]
            if self.bad[i] and not out:
                if articles[0]:
                    out = 2 * articles[i] <= articles[0]
                else:
                    out = self.bad[i] == READERS or 2 * points[i] <= points[0]
            self.left_out[i] = out
        self.blocks = [block for block in self.blocks if not self.left_out[block[0]]]

    def articles(self, of: int) -> int:
        """How many articles with text an element has, itself and nested ones included."""
        if self._articles is None:
            n = len(self.tags)
            texts, self._articles = [False] * n, [0] * n
            for at, *_ in self.blocks:
                texts[at] = True
            for i in range(n - 1, 0, -1):
                self._articles[i] += self.tags[i] == "article" and texts[i]
                self._articles[self.parents[i]] += self._articles[i]
                texts[self.parents[i]] |= texts[i]
        return self._articles[of]

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            # What is wholly beside the text, as a link to skip a menu, is no block of it.
            if text and not self._only_beside:
                at = self._stack[self._open_blocks[-1]] if self._open_blocks else 0
                self.blocks.append((at, text, min(self._linked, len(text)), self._links))
            self._pieces.clear()
        self._linked = self._links = 0
        self._only_beside = True

    def _text(self, text: str) -> None:
        at = self._stack[-1]
        if text and not self.left_out[at]:
            self._pieces.append(_decoded(text))
            if self._open.get("a"):
                self._linked += len(text)
            if not self.beside[at] and not text.isspace():
                self._only_beside = False

    def _pop(self) -> None:
        tag = self.tags[self._stack.pop()]
        self._open[tag].pop()
        if tag in BLOCKS:
            self._open_blocks.pop()

    def _innermost(self, names: set[str] | frozenset[str]) -> int:
        """Depth of the innermost open element of these names, 0 if none."""
        return max((self._open[name][-1] for name in names if self._open.get(name)), default=0)

    def _close(self, names: set[str], barrier: set[str] | frozenset[str]) -> None:
        """End the innermost open element of these names, and all inside it."""
        depth = self._innermost(names)
        if barrier is BLOCKS:
            stop = self._open_blocks[-1] if self._open_blocks else 0
        else:
            stop = self._innermost(barrier)
        if not depth or depth < stop:
            return
        if self._open_blocks and self._open_blocks[-1] >= depth:
            self._flush()
        while len(self._stack) > depth:
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if self.tags[self._stack[-1]] == "head" and tag not in IN_HEAD:
            self._close({"head"}, frozenset())
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self._text(" ")
        elif tag == "a":
            self._links += 1
        if tag in VOID:
            return
        hidden, bad, good = _names(attributes) if attributes else (False, 0, False)
        parent = self._stack[-1]
        out = self.left_out[parent] or tag in LEFT_OUT
        beside = self.beside[parent]
        if tag not in NEVER_BAD:
            out = out or hidden
            # An inline element is part of a sentence, whatever it is called.
            beside = beside or (bad > 0 and tag not in BLOCKS)
            self.bad.append(bad if tag in BLOCKS and not out else 0)
        else:
            self.bad.append(0)
            if bad == READERS:
                self.readers.add(len(self.tags))
        self.beside.append(beside)
        self.tags.append(tag)
        self.parents.append(parent)
        self.left_out.append(out)
        self.weights.append(
            MAIN_ELEMENT * (tag in ("article", "main")) + GOOD_NAME * (good and not bad and not hidden)
        )
        if tag in BLOCKS:
            self._open_blocks.append(len(self._stack))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        # An inline end tag does not end the blocks around it.
        self._close({tag}, frozenset() if tag in BLOCKS else BLOCKS)

    def _read(self, html: str) -> None:
        at, text_from = 0, 0
        last_end = html.rfind(">")
        ends: _TagEnds | None = None
        # Where no > follows, nothing is a tag but an open comment.
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                self._text(html[text_from:at])
                end = _COMMENT_END.search(html, at + 4)
                at = text_from = end.end() if end else len(html)
                continue
            if at > last_end:
                at = html.find("<!--", at)
                if at < 0:
                    break
                continue
            name = _TAG_NAME.match(html, at)
            if not name:
                if html[at + 1] in "!?/":
                    self._text(html[text_from:at])
                    at = text_from = html.find(">", at) + 1
                else:
                    at += 1
                continue
            self._text(html[text_from:at])
            if ends is None:
                end = _TAG_REST.match(html, name.end())
                if end:
                    after = end.end()
                else:
                    ends = _TagEnds(html, name.end())
                    after = -1
            else:
                after = ends.after(name.end())
            if after < 0:  # a quote is not closed
                after = html.find(">", name.end()) + 1
            attributes = html[name.end() : after - 1]
            tag = name[1].lower()
            is_end = html[at + 1] == "/"
            at = text_from = after
            if is_end:
                self._end(tag)
                continue
            if tag == "html" or (tag == "body" and self._has_body):
                continue
            self._has_body |= tag == "body"
            self._start(tag, attributes)
            if tag in RAW:
                # Everything up to the end tag is text of the element.
                end = _RAW_ENDS[tag].search(html, at)
                at = end.start() if end else len(html)
        self._text(html[text_from:])
        self._flush()


def _points(tag: str, text: str) -> float:
    if tag in HEADINGS:
        return 0.0
    if len(text) < SHORT_PARAGRAPH:
        return len(text) / SHORT_PARAGRAPH
    return 1 + text.count(",") + min(len(text) / 100, 3.0)


def _climb(page: Page, best: int, chars: list[int], linked: list[int]) -> int:
    """The element whose whole text belongs to the best container's.

    This is its article or main, or one around that which has no other article; without
    one, the highest element which adds little but headings and paragraphs.
    """
    above = [best]
    while page.parents[above[-1]] >= 0:
        above.append(page.parents[above[-1]])
    top = -1
    for i in above:
        if page.tags[i] in MAIN_TAGS and not page.left_out[i]:
            if top >= 0 and page.articles(i) > page.articles(top):
                break
            top = i
    if top >= 0:
        return top
    prose = [0] * len(page.tags)
    for at, text, in_links, _ in page.blocks:
        if page.tags[at] in HEADINGS or (page.tags[at] in PARAGRAPHS and 4 * in_links < len(text)):
            prose[at] += len(text)
    for i in range(len(prose) - 1, 0, -1):
        prose[page.parents[i]] += prose[i]
    top = best
    for i in above[1:]:
        if page.tags[i] in ("html", "body"):
            break
        if prose[i] - prose[top] < PROSE_SHARE * (chars[i] - chars[top]):
            break
        top = i
    return top


def main_blocks(page: Page) -> list[str]:
    """The kept blocks of a page, in page order."""
    n = len(page.tags)
    scores, chars, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
    for at, text, in_links, n_links in page.blocks:
        chars[at] += len(text)
        linked[at] += in_links
        links[at] += n_links
        tag, points = page.tags[at], _points(page.tags[at], text)
        # A container's own text counts for itself, a paragraph's for its parents.
        up = page.parents[at] if tag in PARAGRAPHS and at else at
        share = 1
        while up >= 0 and share <= 4:
            scores[up] += points / share
            up, share = page.parents[up], share + 1
    for i in range(n - 1, 0, -1):
        parent = page.parents[i]
        chars[parent] += chars[i]
        linked[parent] += linked[i]
        links[parent] += links[i]

    def density(i: int) -> float:
        return linked[i] / chars[i] if chars[i] else 0.0

    def final(i: int) -> float:
        return (scores[i] + page.weights[i]) * (1 - density(i)) if chars[i] else 0.0

    candidates = [i for i in range(n) if chars[i] and not page.left_out[i]]
    if not candidates:
        return []
    finals = {i: final(i) for i in candidates}
    # Paragraphs are content of a container, not containers.
    containers = [i for i in candidates if page.tags[i] not in PARAGRAPHS | HEADINGS] or candidates
    best = max(containers, key=lambda i: (finals[i], -i))
    needed = max(10.0, SIBLING_SHARE * finals[best])
    top = _climb(page, best, chars, linked)
    kept = {top}
    for i in candidates:
        if i != top and top and page.parents[i] == page.parents[top]:
            prose = page.tags[i] == "p" and density(i) < 0.25 and chars[i] > 80
            if finals[i] >= needed or prose:
                kept.add(i)
    inside, in_article = [False] * n, [False] * n
    for i in range(n):
        up = page.parents[i]
        in_article[i] = page.tags[i] in MAIN_TAGS or (up >= 0 and in_article[up])
        list_of_links = (
            page.tags[i] in ("ul", "ol", "dl", "div", "section", "table")
            and i not in kept
            and not in_article[i]
            and links[i] >= LEAST_LINKS
            and density(i) >= LINK_LIST
        )
        inside[i] = i in kept or (up >= 0 and inside[up] and not list_of_links)
    return [text for at, text, _, _ in page.blocks if inside[at]]


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(Page(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    narrow = pages.select("page_id", "url", "html")
    schema = narrow.drop("html").schema.add("text", "string").add("n_chars", "long")

    def extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            columns = [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array(map(len, texts), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(extract_task, schema)

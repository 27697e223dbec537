"""HTML extraction: pages score their containers, hosts vote on generalised paths, pages are read again by the winning path."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import keep, ship, through_python

#: Winning paths of up to this many hosts are sent to all tasks; more are joined by host.
HOSTS_TO_ALL = 100_000

# Elements of HTML by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg math object canvas select".split())
SKIPPED = frozenset("head nav footer aside form button menu dialog fieldset search".split())
CONTAINERS = frozenset("body main article section div td center".split())
#: An element that begins inside one of these ends it.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th"), "option": ("option",), "a": ("a",),
}
#: Words in a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs footer contentinfo complementary masthead comment comments commentlist disqus respond reply "
    "replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations widget pagination pager toolbar skip copyright search".split())
ARTICLES = frozenset(("article", "main"))
#: A container is entered while it holds this share of the text around it and no first heading stays outside.
ENTER_FROM = 0.75
#: A page is read by its host's path if that finds at least this share of what its own best container holds.
TRUST_FROM = 0.5
#: If it finds less than this share, the path only says where the article begins: what follows in the page's own container stays.
WHOLE_FROM = 0.95

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>|[^>]*\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_HIDDEN = re.compile(r"""\bhidden(?=[\s>/]|=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class Page:
    """Blocks of text of a page with their containers, without what can never be the article.

    ``elements`` has (tag, generalised path, parent) of each block element met, ``blocks`` (text, characters outside links,
    element). The generalised path names each element by tag and classes, with digits as 0.
    """

    def __init__(self, source: str):
        self.elements: list[tuple[str, str, int]] = [("html", "html", -1)]
        self.blocks: list[tuple[str, int, int]] = []
        self._text: list[str] = []
        self._plain = 0
        self._stack: list[tuple[str, int, bool]] = [("html", 0, False)]       # tag, element, whether it is left out
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, self._plain, self._stack[-1][1]))
            self._text, self._plain = [], 0

    def _add(self, raw: str) -> None:
        if raw and not self._stack[-1][2]:
            text = entities.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if not any(tag == "a" for tag, _, _ in self._stack[-2:]):
                self._plain += len(text) - text.count(" ")

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                if tag in BLOCKS:
                    self._flush()
                del self._stack[i:]
                return
            if tag not in BLOCKS and self._stack[i][0] in BLOCKS:
                return                                                # an inline end does not leave its block

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            open_tags = [t for t, _, _ in self._stack]
            if "p" in open_tags:
                self._close("p")
        for other in ENDS.get(tag, ()):
            scope = {"li": ("ul", "ol", "menu", "dir"), "option": ("select",)}.get(tag, ("table",))
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == other:
                    if tag in BLOCKS:
                        self._flush()
                    del self._stack[i:]
                    break
                if self._stack[i][0] in scope or (tag == "a" and self._stack[i][0] in BLOCKS):
                    break
        if tag in VOID:
            return
        _, above, out = self._stack[-1]
        if tag not in BLOCKS:
            if tag == "a":
                self._stack.append((tag, above, out))
            return
        found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        classes = re.sub(r"\d+", "0", found.get("class", "")).split()
        path = ".".join([tag, *sorted(set(classes))])
        self.elements.append((tag, f"{self.elements[above][1]}>{path}", above))
        if not out and tag not in ("html", "body", "main"):
            words = set(re.split(r"[^a-z]+", " ".join((*classes, found.get("id", ""), found.get("role", ""))).lower()))
            inside = any(t in ARTICLES for t, _, _ in self._stack)
            out = (tag in SKIPPED or not inside and (tag == "header" or "header" in words) or bool(words & MARKS)
                   or bool(_HIDDEN.search(attributes)))
        self._stack.append((tag, len(self.elements) - 1, out))

    def _read(self, source: str) -> None:
        at = 0
        head = False
        while True:
            m = _TAG.search(source, at)
            if m is None:
                break
            if not head:
                self._add(source[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if not m[3].endswith(">"):
                break                                                 # the page ends within a tag
            if tag == "head":
                head = not m[1]
            elif tag == "body" and not m[1]:
                head = False
            if m[1]:
                self._close(tag)
            elif tag in RAW and not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._add(" ")
            elif tag in ("html", "body") and tag in [t for t, _, _ in self._stack]:
                continue
            else:
                self._open(tag, m[3])
                if tag in ("br", "img"):
                    self._add(" ")
        if not head:
            self._add(source[at:] if m is None else "")
        self._flush()

    def weights(self) -> list[int]:
        """Characters outside links in each element, those of the elements inside it included."""
        held = [0] * len(self.elements)
        for _, plain, e in self.blocks:
            held[e] += plain
        for e in range(len(held) - 1, 0, -1):
            held[self.elements[e][2]] += held[e]
        return held

    def best(self) -> tuple[int, int]:
        """(container, its score): from the outside in, as long as one container holds most of the text."""
        held = self.weights()
        inner: dict[int, list[int]] = {}
        title: set[int] = set()
        for e in range(1, len(self.elements)):
            tag, _, up = self.elements[e]
            if tag == "h1" and held[e]:
                title.update(self._above(e))
            while up > 0 and self.elements[up][0] not in CONTAINERS:
                up = self.elements[up][2]
            if tag in CONTAINERS:
                inner.setdefault(up, []).append(e)
        here = 0
        while inner.get(here) and self.elements[here][0] not in ARTICLES:
            top = max(inner[here], key=lambda e: (held[e], -e))
            if held[top] < ENTER_FROM * held[here] or held[top] == 0:
                break
            if here in title and top not in title and self.elements[top][0] not in ARTICLES:
                break
            here = top
        return here, held[here]

    def _above(self, e: int) -> Iterator[int]:
        while e >= 0:
            yield e
            e = self.elements[e][2]

    def text(self, path: str | None = None) -> str:
        """The blocks of the containers at ``path`` if it leads to enough text, else of the page's own best one.

        If the path leads to a part only of the page's own container, the blocks of that after the part begins stay as well.
        """
        own, score = self.best()
        held = self.weights()
        roots = {e for e, (_, p, _) in enumerate(self.elements) if p == path} if path else set()
        outer = [e for e in roots if not any(a in roots for a in self._above(self.elements[e][2]))]
        found = sum(held[e] for e in outer)
        if found < TRUST_FROM * score or not outer:
            roots = {own}
        inside, around = [False] * len(self.elements), [False] * len(self.elements)
        for e, (_, _, up) in enumerate(self.elements):
            inside[e] = e in roots or up >= 0 and inside[up]
            around[e] = e == own or up >= 0 and around[up]
        kept = [inside[e] for _, _, e in self.blocks]
        if own not in roots and found < WHOLE_FROM * score and True in kept:
            begin = kept.index(True)
            kept = [k or i > begin and around[e] for i, (k, (_, _, e)) in enumerate(zip(kept, self.blocks))]
        return "\n".join(t for (t, _, _), k in zip(self.blocks, kept) if k)


def _hosted(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): per host the path that most of its pages hold to be their best container's, ties to more text, then by name.

    Tasks count their pages' votes before the shuffle, so a host with a third of all pages is a few rows a task.
    """
    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes: dict[tuple[str, str], list[int]] = {}
            for host, source in zip(batch["host"], batch["html"]):
                page = Page(source)
                e, score = page.best()
                if score:
                    own = votes.setdefault((host, page.elements[e][1]), [0, 0])
                    own[0] += 1
                    own[1] += score
            yield pd.DataFrame([(*k, *v) for k, v in votes.items()], columns=["host", "path", "votes", "score"])

    votes = ship(pages).select("host", "html").mapInPandas(vote, "host string, path string, votes long, score long").groupBy(
        "host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, one row per row of ``pages``; null html is empty.

    Pages without a host are a host of their own. Character references are decoded, white space inside a block becomes one blank,
    blocks are joined by a line feed. A page on which the host's path finds too little is read by its own best container.
    """
    hosted = _hosted(pages, key, url, html)
    paths = keep(host_paths(hosted))
    small = paths.limit(HOSTS_TO_ALL + 1).count() <= HOSTS_TO_ALL
    placed = hosted.join(F.broadcast(paths) if small else paths, "host", "left").select("page_id", "url", "path", "html")
    kind, sent = placed.schema["page_id"].dataType.simpleString(), through_python(placed, "page_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [Page(h).text(p) for h, p in zip(batch["html"], batch["path"])]
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    found = ship(sent).mapInPandas(read, f"page_id {sent.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast(kind))

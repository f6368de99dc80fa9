"""Main text of web pages, by containers that the pages of a host agree on.

Each page scores its containers; the path of the best one, as generalised tags and classes, is the page's vote.
Votes are counted per host in Spark, and every page is read again with its host's path; a page that has no
container of that path is read with its own. What is read is the whole article around the container: its headline,
lead and further sections too.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.runtime import slices, stored
from certloom.session import broadcast_if_small

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")

# Element names of HTML and words that pages use as class names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "header", "hidden", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager",
    "pagination", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "figcaption", "dd", "dt", "td", "th"}
LISTS = {"ul", "ol", "dl", "table", "menu"}


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag and classes with digits generalised, whether the element is no part of any main text)."""
    left_out, classes = tag in LEFT_OUT, []
    if attributes.strip():
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                for word in value.split():
                    parts = [p for p in re.split(r"[^a-z0-9]+", word) if p]
                    left_out |= bool(parts) and (parts[0] in NOISE or parts[-1] in NOISE and parts[0] not in ("has", "with", "no", "without"))
                    if name == "class":
                        classes.append(re.sub(r"\d+", "#", word))
            elif name == "role":
                left_out |= value in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                left_out = True
            elif name == "style":
                left_out |= "display:none" in value.replace(" ", "")
    if tag in ("html", "body", "main", "article"):
        left_out = False
    return ".".join([tag, *sorted(set(classes))]), left_out


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, str]]:
    """The text blocks outside left-out elements: (path of open block elements, text, characters in links, innermost tag).

    Tags that are not closed, closed twice or closed in the wrong order are taken as browsers roughly do.
    """
    stack: list[tuple[str, str, bool]] = []  # tag, step, left out
    hidden, found, pieces, linked, at = 0, [], [], 0, 0

    def flush():
        nonlocal pieces, linked
        text = " ".join(references.unescape("".join(pieces)).split())
        if text:
            path = tuple(s for t, s, _ in stack if t in BLOCKS)
            found.append((path, text, linked, next((t for t, _, _ in reversed(stack) if t in BLOCKS), "")))
        pieces, linked = [], 0

    def close(to: int):
        nonlocal hidden
        hidden -= sum(x[2] for x in stack[to:])
        del stack[to:]

    def take(text: str):
        nonlocal linked
        if text and not hidden:
            pieces.append(text)
            if any(t == "a" for t, _, _ in stack):
                linked += len(text.strip())

    end = len(page)
    while at < end:
        mark = _MARKUP.search(page, at)
        take(page[at : mark.start() if mark else end])
        if not mark:
            break
        at = mark.end()
        slash, tag, attributes = (mark[1], mark[2], mark[3]) if mark[2] else (mark[4], mark[5], mark[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if slash:
            down = next((k for k in reversed(range(len(stack))) if stack[k][0] == tag), None)
            if down is not None:
                close(down)
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            down = next((k for k in reversed(range(len(stack))) if stack[k][0] == "p"), None)
            if down is not None:
                close(down)
        if tag in SIBLINGS:
            for k in reversed(range(len(stack))):
                if stack[k][0] in LISTS:
                    break
                if stack[k][0] in SIBLINGS[tag]:
                    close(k)
                    break
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            step, left_out = _step(tag, attributes)
            stack.append((tag, step, left_out))
            hidden += left_out
    flush()
    return found


def best_path(found: list) -> tuple[tuple[str, ...], int]:
    """The container with the highest score, and the score; () if the page has no text.

    A block counts for the element around it and half for the one around that, less what stands in links.
    Containers of one path count together; ties go to the shorter, then the smaller path.
    """
    scores: dict[tuple[str, ...], int] = defaultdict(int)
    for path, text, linked, tag in found:
        worth = 2 * max(0, len(text) - 2 * linked)
        around = path[:-1] if tag in ("p", "li", "blockquote", "pre", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6") else path
        scores[around] += worth
        scores[around[:-1]] += worth // 2
    for path in scores:
        if path and path[-1].split(".")[0] in ("article", "main"):
            scores[path] += scores[path] // 2
    if not scores:
        return (), 0
    path = max(scores, key=lambda p: (scores[p], -len(p), [-ord(c) for c in " ".join(p)]))
    return path, scores[path]


def climbed(found: list, path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of the whole article around a container: the nearest article or main, if there is one.

    Otherwise outer containers are taken as long as what they add is text of its own: paragraphs, headings and the like
    of which at most a third of the characters stand in links. The body of a page is never taken for its article.
    """
    for depth in range(len(path), 0, -1):
        if path[depth - 1].split(".")[0] in ("article", "main"):
            return path[:depth]
    while len(path) > 1 and path[-2].split(".")[0] not in ("body", "html"):
        added = [b for b in found if b[0][: len(path) - 1] == path[:-1] and b[0][: len(path)] != path]
        if any(tag not in PROSE for _, _, _, tag in added) or 3 * sum(b[2] for b in added) > sum(len(b[1]) for b in added):
            break
        path = path[:-1]
    return path


def main_text(page: str | None, path: tuple[str, ...] | None = None) -> str:
    """Text of the article around the containers of `path`, else around the page's own best ones."""
    found = blocks(page or "")
    if not path or not any(b[0][: len(path)] == path for b in found):
        path = best_path(found)[0]
    path = climbed(found, path)
    return " ".join(b[1] for b in found if b[0][: len(path)] == path)


def host_paths(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path): per host the path with the most votes, ties by score, then by path. Steps are joined by spaces."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, rows = batch.column("u").to_pylist(), []
            for first, texts in slices(batch, "h"):
                for url, page in zip(urls[first:], texts):
                    path, score = best_path(blocks(page))
                    if score > 0:
                        rows.append((host_of(url), " ".join(path), score))
            hosts, paths, scores = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = pages.select(F.col(url_column).alias("u"), F.col(html_column).alias("h")).mapInArrow(vote, "host string, path string, score long")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars. A null html is empty; a page without text gives ''.

    Pages whose url is null or has no host vote together. The winning paths are joined by a broadcast only
    after their size was checked, else by a shuffle on the host. Other columns are not looked at.
    """
    winners = stored(host_paths(pages, url_column, html_column), "paths")
    winners = broadcast_if_small(winners, F.length("host") + F.length("path") + 16)
    source = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("u"), F.col(html_column).alias("h"))
    # The host in Spark's terms, as `host_of` has it.
    host = F.lower(F.regexp_extract(F.coalesce("u", F.lit("")), _HOST.pattern, 1))
    joined = source.withColumn("host", host).join(winners, "host", "left").select("id", "u", "h", "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column("path").to_pylist(), []
            for first, htmls in slices(batch, "h"):
                texts += [main_text(h, tuple(p.split(" ")) if p else None) for h, p in zip(htmls, paths[first:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "u", "text", "n_chars"])

    fields = [("id", source.schema["id"].dataType), ("u", source.schema["u"].dataType), ("text", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in fields])
    return joined.mapInArrow(read, schema).withColumnsRenamed({"id": id_column, "u": url_column})

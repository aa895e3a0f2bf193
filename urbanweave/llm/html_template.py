"""Main text of web pages by deducing the template that pages of a host share.

Tags are told apart by their place (the path of open blocks above them). Over the pages of
a host every such token has an occurrence vector; tokens with equal vectors form an
equivalence class. A vector is never materialised: it is represented by two sums of page
hashes times counts, which Spark aggregates in any order. A class is kept when it is
frequent and nests, that is when it holds the opening and the closing token of its nodes
once a page; kept nodes are the host's template. What lies under a template node and under
no deeper one is a slot. Text and link mass of the slots decide which node holds the main
text, and each page's blocks under that node are extracted.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.arrays import slices
from urbanweave.llm.spark import checkpoint

#: HTML elements by what they do to text. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("article main section div body td".split())
APART = frozenset("script style textarea title noscript template iframe head nav header footer aside menu form button select dialog svg canvas object audio video map".split())
#: Names in class, id or role that mark what is not the article. Fixed values.
APART_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist complementary contentinfo cookie cookies consent disclaimer disqus dropdown footer form gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion related reply replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
#: Words that only say where or what kind of box a named part is. A name is apart if it holds a word of the list above and
#: else only these: "site-footer" is, "share-price" and "notice-of-appeal" are not. Fixed values.
PLACES = frozenset("area bar block body bottom box btn button buttons container content desktop fixed global group head heading holder icon icons inner item items js large left link links list local main menu mobile module outer page panel post primary right row secondary section site small sticky sub text title tools top ui unit wrap wrapper".split())
#: Paths longer than this go on from a digest of themselves, so the memory of a page grows with its tags, not with their square.
PATH = 2000
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A class or id that says what a node has or lacks, not what it is.
_MODIFIER = re.compile(r"^(?:has|with|without|no)[-_]|[-_]open$")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
#: Elements that an opening tag of the same kind ends.
SELF_ENDING = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dd", "dd": "dd", "option": "option"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def parse(source: str) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """Events of a page: (kind, path or text, apart, in a link, main).

    kind is `open`, `close`, `text` or `break` (a white space that the markup makes). `apart`
    tells that an element above is not part of an article; `main` that it is marked as the
    article. Tags that are never closed end with their parent; broken markup never fails.
    """
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, path, apart, link, main
    at = 0
    while True:
        m = _TAG.search(source, at)
        stop = m.start() if m else len(source)
        path, apart, link, main = stack[-1][1:] if stack else ("", False, False, False)
        if stop > at:
            yield "text", source[at:stop], apart, link, main
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                while len(stack) > depth:
                    gone = stack.pop()
                    if gone[0] not in INLINE:
                        yield "close", gone[1], gone[2], gone[3], gone[4]
            elif name in ("p", "br"):
                yield "break", "", apart, link, main
            continue
        if name in VOID:
            if name not in ("img", "wbr"):
                yield "break", "", apart, link, main
            continue
        if name not in INLINE:
            ended = SELF_ENDING.get(name)
            closes = "p" if ended is None or name == "p" else None
            for k in range(len(stack) - 1, -1, -1):
                above = stack[k][0]
                if (ended and SELF_ENDING.get(above) == ended) or above == closes:
                    while len(stack) > k:
                        gone = stack.pop()
                        if gone[0] not in INLINE:
                            yield "close", gone[1], gone[2], gone[3], gone[4]
                    break
                if above not in INLINE and above not in SELF_ENDING and above not in HEADINGS:
                    break
            path, apart, link, main = stack[-1][1:] if stack else ("", False, False, False)
        attributes = m[3] or ""
        marks = []
        if attributes:
            for kind, a, b, c in _NAMES.findall(attributes):
                value = (a or b or c).lower()
                marks += [(kind.lower(), x) for x in value.split()]
        named = [{w for w in re.split(r"[-_\d]+", x) if w} for _, x in marks if not _MODIFIER.search(x)]
        named = any(w & APART_NAMES and w <= APART_NAMES | PLACES for w in named)
        article = name in ("article", "main") or ("role", "main") in marks
        apart = apart or name in APART or (named and name not in ("html", "body") and not article) or bool(attributes and _HIDDEN.search(attributes))
        link, main = link or name == "a", main or article
        if name not in INLINE:
            tail = ".".join(sorted(x for kind, x in marks if not re.search(r"\d", x)))
            path = f"{path}/{name}.{tail}" if tail else f"{path}/{name}"
            if len(path) > PATH:
                path = f"/{name}.~{hashlib.md5(path.encode()).hexdigest()}"
            yield "open", path, apart, link, main
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            if name not in INLINE:
                yield "close", path, True, link, main
            continue
        if attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        stack.append((name, path, apart, link, main))
    while stack:
        gone = stack.pop()
        if gone[0] not in INLINE:
            yield "end", gone[1], gone[2], gone[3], gone[4]  # a node that the page never closes


def main_text(source: str, root: str | None) -> str:
    """Blocks of a page under its host's content node, in page order, joined by one space.

    Pages without that node fall back to the nodes marked as article, and then to all that
    is not set apart.
    """
    blocks: dict[str, list[str]] = {"root": [], "main": [], "all": []}
    run: list[str] = []
    under, scope = 0, ("all",)
    above = root + "/" if root else None

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            for s in scope:
                blocks[s].append(text)

    for kind, what, apart, _, main in parse(source):
        if kind == "text":
            if not apart:
                run.append(what)
        elif kind == "break":
            run.append(" ")
        else:
            flush()
            if what == root:
                under += 1 if kind == "open" else -1
            now_main = main
            if kind != "open":
                # Behind a closing tag the parent's marks hold; they are those of the shorter path.
                now_main = False
            scope = ("all", *(("main",) if now_main else ()), *(("root",) if under > 0 else ()))
        if kind == "text" and not apart:
            wanted = ("all", *(("main",) if main else ()), *(("root",) if under > 0 else ()))
            if wanted != scope and "".join(run[:-1]).strip():
                last = run.pop()
                flush()
                run.append(last)
            scope = wanted
    flush()
    chosen = next((blocks[s] for s in ("root", "main", "all") if blocks[s] and (s != "root" or above)), [])
    return " ".join(chosen)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence sums of every token and text mass of every node, summed over the pages of a slice."""
    for batch in batches:
        for part in slices(batch, "html"):
            sums: dict[tuple[str, str, str], list[int]] = {}
            for page, host, source in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                counts: dict[tuple[str, str], list[int]] = {}
                place = [""]
                for kind, what, apart, link, main in parse(source or ""):
                    if kind == "text":
                        size = 0 if apart else len(what.strip())
                        if size:
                            row = counts.setdefault(("open", place[-1]), [0, 0, 0, 0, 0])
                            row[1] += size
                            row[2] += size if link else 0
                            row[3] |= main
                    elif kind != "break":
                        if kind == "open":
                            place.append(what)
                        elif len(place) > 1:
                            place.pop()
                        row = counts.setdefault((kind, what), [0, 0, 0, 0, 0])
                        row[0] += 1
                        row[3] |= main
                        row[4] |= apart
                raw = str(page).encode()
                h1, h2 = zlib.crc32(raw) >> 8, zlib.crc32(b"~" + raw) >> 8
                for (kind, what), (n, mass, links, main, apart) in counts.items():
                    row = sums.setdefault((host, kind, what), [0] * 8)
                    for k, x in enumerate((n * h1, n * h2, bool(n), n, mass, links)):
                        row[k] += x
                    row[6] |= main
                    row[7] |= apart
            names = ["host", "kind", "path", "v1", "v2", "pages", "total", "mass", "links", "main", "apart"]
            columns = [[k[i] for k in sums] for i in range(3)] + [[int(v[i]) for v in sums.values()] for i in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(columns)], names)


def host_of(url: str = "url"):
    """Host of a URL in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, frequent: float = 0.5, holds: float = 0.9) -> DataFrame:
    """The content node of every host: (host, root). pages: page_id, host, html.

    Candidate nodes are containers of the template that are not set apart. A node marked as
    the article is taken if half the host's text lies in it, else the deepest node that holds
    `holds` of it. Hosts without such a node are missing.
    """
    schema = "host string, kind string, path string, v1 long, v2 long, pages long, total long, mass long, links long, main long, apart long"
    tokens = pages.select("page_id", "host", "html").mapInArrow(_tokens, schema)
    tokens = tokens.groupBy("host", "kind", "path").agg(*[F.sum(c).alias(c) for c in ("v1", "v2", "pages", "total", "mass", "links")], F.max("main").alias("main"), F.max("apart").alias("apart"))
    tokens = checkpoint(tokens)
    sizes = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    # A class is the set of tokens with one vector; a node nests in it when it brings both its tokens.
    opened = tokens.where("kind = 'open' and total > 0 and total = pages")
    closed = tokens.where("kind = 'close'").select("host", "path", "v1", "v2", "pages")
    nodes = opened.join(closed, ["host", "path", "v1", "v2", "pages"]).join(sizes, "host").where(F.col("pages") >= F.col("n_pages") * frequent)
    names = F.split("path", "/")
    nodes = nodes.where("apart = 0").withColumn("name", F.regexp_extract(F.element_at(names, -1), r"^[^.]*", 0)).where(F.col("name").isin(*CONTAINERS))
    # Text of a slot counts for its node and for all nodes above it.
    slots = tokens.where("kind = 'open' and mass > links * 2 or main > 0 and mass > 0").select("host", "mass", F.filter(F.split("path", "/"), lambda x: x != "").alias("steps"))
    above = slots.select("host", "mass", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("steps"), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("steps", 1, k), "/")))).alias("path"))
    mass = above.groupBy("host", "path").agg(F.sum("mass").alias("held"))
    whole = slots.groupBy("host").agg(F.sum("mass").alias("whole"))
    share = F.col("held") / F.greatest(F.col("whole"), F.lit(1))
    ranked = nodes.select("host", "path", "name").join(mass, ["host", "path"]).join(whole, "host").withColumn("share", share)
    marked = F.col("name").isin("article", "main") & (F.col("share") >= 0.5)
    ranked = ranked.where(marked | (F.col("share") >= holds))
    return ranked.groupBy("host").agg(F.max_by("path", F.struct(marked.alias("marked"), F.when(marked, -F.length("path")).otherwise(F.length("path")).alias("depth"), "path")).alias("root"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(source, root) if source else "" for source, root in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null, empty and textless pages give an empty text. Very deep pages go by digests of their
    paths, from which no text reaches the nodes above. Pages whose url is null or has no host
    share the template of the empty host. Repeated rows stay repeated; extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).withColumn("host", host_of("url"))
    roots = checkpoint(templates(rows))
    few = len(roots.limit(50_001).select(F.lit(1)).take(50_001)) <= 50_000
    joined = rows.join(F.broadcast(roots) if few else roots, "host", "left").select("page_id", "url", "html", "root")
    out = joined.mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

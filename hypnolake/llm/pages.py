"""Main text of web pages by equivalence-class template deduction.

Every page becomes tokens: opening tags under their path, and text nodes under theirs. The occurrence vector of a token says how often it stands
on each of its host's distinct pages; it is kept as a 64-bit sum of hashes of (page, count), so vectors of any length are compared by one
number and summed by Spark. Tokens of a host with the same vector form an equivalence class. A class is valid if it has at least
two tokens (an element is two, its start and its end) and stands on at least half of the pages; nested by path under valid parents, the valid classes are the host's template.

What the template leaves open are slots. Slots inside ``article`` or ``main`` are the text. On a page without either, they are those of the
deepest template element that holds most of the host's text, without the template's own texts and without blocks that are mostly links. Elements
that are furniture by name, role or class (menus, notices, adverts, comments and so on) hold no slots.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import query, table

MIN_SHARE = 0.5  # of a host's distinct pages, for a valid class
MIN_TOKENS = 2
MAIN_SHARE = 0.6  # of a host's text, for the element that holds it
LINK_SHARE = 0.6
BROADCAST_TOKENS = 500_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's elements by kind, and names that mark furniture.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav footer aside form head menu dialog button".split())
HOLDERS = set("html body div section main article td center".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget notice notices cookie cookies consent gdpr banner alert ad ads "
    "advert adverts advertisement sponsor sponsored promo promotion form newsletter subscribe signup login search comment comments reply replies respond "
    "disqus share sharing social related recommended pagination pager popup modal toolbar".split()
)
ARTICLE_MARKS = set("ad ads advert comment comments promo related reply replies respond sponsored teaser".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"form"}}


@dataclass(slots=True)
class Node:
    """An open element: name, path of its block elements with classes, whether furniture or main text holds it."""

    name: str
    path: str
    furniture: bool
    main: bool


@dataclass(slots=True)
class Block:
    path: str
    text: str
    main: bool
    link_chars: int


@dataclass
class Page:
    """Blocks of text outside furniture, in order, and the opening tags by path."""

    blocks: list[Block] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)


def _furniture(name: str, attributes: str, inside_main: bool) -> tuple[bool, str]:
    """Whether an opening tag starts furniture, and its class names for the path."""
    found = name in FURNITURE or (name == "header" and not inside_main)
    if not attributes or not attributes.strip():
        return found, ""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    classes = values.get("class", "")
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True, classes
    if values.get("role", "").lower() in ROLES:
        return True, classes
    if name not in ("html", "body", "main"):
        words = {w.lower() for w in _WORDS.findall(f"{classes} {values.get('id', '')}")}
        found = found or bool(words & (ARTICLE_MARKS if name == "article" else MARKS))
        found = found or ("header" in words and name != "article" and not inside_main)
    return found, classes


def parse(source: str) -> Page:
    """One pass over the markup; unclosed elements end where HTML ends them, stray ends are passed over."""
    page = Page()
    stack = [Node("", "", False, False)]
    text: list[str] = []
    links = link_depth = 0

    def flush():
        nonlocal links
        if text:
            words = html.unescape("".join(text)).split()
            if words:  # nothing is gathered inside furniture
                page.blocks.append(Block(stack[-1].path, " ".join(words), stack[-1].main, links))
            text.clear()
            links = 0

    def close(names: set[str], fence: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in fence:
                return

    for m in _TOKEN.finditer(source):
        name = m[3]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not stack[-1].furniture:
                    text.append(piece)
                    if link_depth:
                        links += len(piece.strip())
            continue
        name = name.lower()
        if m[2]:  # an end tag
            if name in BLOCK:
                flush()
                close({name}, {"article", "main", "body"} - {name})
            elif name == "a":
                link_depth = 0
            elif stack[-1].name == name:
                stack.pop()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in _CLOSES:
                close(_CLOSES[name], _FENCE[name])
            elif name in ("article", "main"):
                close({"nav", "header"}, {"article", "main", "body"})
            if any(n.name == "p" for n in stack[-3:]):
                close({"p"}, {"td", "th", "li", "blockquote", "div", "section", "article", "main"})
        top = stack[-1]
        furniture, classes = _furniture(name, m[4], top.main)
        if name == "a":
            link_depth = 1
        if name in VOID or m[4].endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK:
            path = f"{top.path}/{name}.{classes}" if classes else f"{top.path}/{name}"
            if len(path) > 512:
                path = f"{top.path[:400]}/{xxhash.xxh64_hexdigest(path)}"
            if not top.furniture:
                page.tags[path] += 1
            stack.append(Node(name, path, top.furniture or furniture, top.main or name in ("article", "main")))
        elif furniture and not top.furniture:  # furniture on an inline element
            held = "".join(text)
            stack.append(Node(name, top.path, True, top.main))
            text[:] = [held]
    flush()
    return page


def _hash(kind: str, path: str, text: str = "") -> int:
    h = xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}".encode())
    return h - (1 << 64) if h >> 63 else h


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


@dataclass
class Template:
    """A host's valid classes: hashes of template texts, and the path of the element that holds the text."""

    texts: frozenset[int] = frozenset()
    holder: str = ""


def nest(tokens: list[dict]) -> Template:
    """The template of a host from the tokens of its classes: a class counts if its tokens stand under valid elements."""
    tags = {t["path"]: t for t in tokens if t["kind"] == "tag"}
    valid: set[str] = {""}
    for path in sorted(tags, key=lambda p: p.count("/")):
        if tags[path]["valid"] and _parent(path) in valid:
            valid.add(path)
    texts = frozenset(t["token"] for t in tokens if t["kind"] == "text" and t["valid"] and t["path"] in valid)
    total = max((t["chars"] for p, t in tags.items() if p.count("/") == 1), default=0)
    holders = [p for p in valid - {""} if total and tags[p]["chars"] >= MAIN_SHARE * total and re.match(r"\w+", p.rpartition("/")[2])[0] in HOLDERS]
    return Template(texts, max(holders, key=lambda p: (p.count("/"), p), default=""))


def main_text(page: Page, template: Template) -> str:
    if any(b.main for b in page.blocks):
        return "\n".join(b.text for b in page.blocks if b.main)
    slots = [b for b in page.blocks if b.link_chars < LINK_SHARE * len(b.text) and _hash("text", b.path, b.text) not in template.texts]
    held = [b for b in slots if template.holder and (b.path + "/").startswith(template.holder + "/")]
    return "\n".join(b.text for b in (held or slots))


TOKENS = "host string, page long, kind string, path string, token long, n long, chars long"


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, tokens) for hosts with two distinct pages or more; tokens stand on at least half of these. ``pages``: host, html.

    Equal pages count once. Counts are combined before each shuffle, and a frequent host is spread by its pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                source = source.as_py()
                page, digest = parse(source), _hash("page", "", source)
                under: Counter = Counter()
                for b in page.blocks:
                    path = b.path
                    while path:
                        under[path] += len(b.text)
                        path = _parent(path)
                out += [(host, digest, "tag", p, _hash("tag", p), n, under[p]) for p, n in page.tags.items()]
                out += [(host, digest, "text", p, _hash("text", p, t), n, len(t)) for (p, t), n in Counter((b.path, b.text) for b in page.blocks if not b.main).items()]
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    tokens = pages.mapInArrow(run, TOKENS)
    once = tokens.groupBy("host", "token", "page").agg(F.first("kind").alias("kind"), F.first("path").alias("path"), F.max("n").alias("n"), F.max("chars").alias("chars"))
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).cast("string")
    seen = once.groupBy("host", "token").agg(
        F.first("kind").alias("kind"), F.first("path").alias("path"), vector.alias("vector"), F.count("*").alias("support"), F.sum("chars").alias("chars")
    )
    seen = cut_lineage(seen.filter("support > 1"))
    sizes = seen.filter("kind = 'tag'").groupBy("host").agg(F.max("support").alias("pages"))  # the outermost element stands on all of them
    frequent = seen.join(sizes, "host").filter(F.col("support") >= MIN_SHARE * F.col("pages"))
    classes = frequent.groupBy("host", "vector").agg(F.sum(F.when(F.col("kind") == "tag", 2).otherwise(1)).alias("size")).select(F.col("host").alias("host_"), F.col("vector").alias("vector_"), "size")
    marked = frequent.join(classes, (F.col("host") == F.col("host_")) & (F.col("vector") == F.col("vector_")))
    entry = F.struct("kind", "path", "token", "chars", (F.col("size") >= MIN_TOKENS).alias("valid"))
    return marked.groupBy("host").agg(F.collect_list(entry).alias("tokens"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["host", "page", "kind", "path", "token", "n", "chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars per row of ``pages`` (page_id, url, html).

    Null html is empty and has the empty text; pages with a null or odd url share one host; equal rows get equal results; a page of any length
    is read whole; an empty table gives none; other columns are not read. A host's template is bounded by the size of its pages;
    the table of templates is broadcast only while it holds at most ``BROADCAST_TOKENS`` tokens and joined by host else.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = cut_lineage(deduce_templates(rows.select("host", "html")))
    size = templates.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    templates = templates.withColumnRenamed("host", "host_")
    joined = rows.join(F.broadcast(templates) if size <= BROADCAST_TOKENS else templates, F.col("host") == F.col("host_"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            ids, urls, hosts, sources, tokens = batch.columns
            texts = []
            for h, source, given in zip(hosts.to_pylist(), sources, tokens):
                page = parse(source.as_py())
                if h not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[h] = nest(given.as_py() or [])
                texts.append(main_text(page, known[h]))
            yield pa.RecordBatch.from_arrays(
                [ids, urls.cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "html", "tokens").mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op7_pages")
def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))

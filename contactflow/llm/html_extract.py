"""Main text of web pages by equivalence-class template deduction.

1. A page is read into tokens: tags (name with class, id and role) and text blocks.
2. Per host, tokens that occur equally often on every page share an occurrence vector. The vector is held as sums of
   hash(page, count), so tokens are grouped by two aggregates that combine before their shuffles; no host's pages meet in one task.
   A class is kept when it is large (MIN_SIZE tokens) and frequent (MIN_PAGES pages and MIN_SHARE of the host's).
3. On a page, classes are nested into the template: in order of support (once-a-page tokens first), a class is valid where its tokens stand in
   their template order and within one slot of the tokens placed before. Valid text tokens are template text.
4. What lies between template tokens are slots. Slots in an article (or main) element hold the text, whole; without such an element
   all slots do, less template text and blocks that are mostly links. Menus, site headers, footers, sidebars,
   notices, adverts, forms and comments are known by their elements, roles and class names and are left out.

A host's template is at most MIN_SHARE^-1 pages' worth of tokens, so it travels as one array per host; the join with
the pages broadcasts only below Spark's size threshold and otherwise is a skewed join that Spark splits.

Edge cases: a null or empty html gives ''; a null or odd URL belongs to the host ''; truncated pages, unclosed or stray tags, raw
elements cut off at the end and bare '<' or '&' are read as browsers do. Repeated rows give repeated results; null ids are carried.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.llm.common import written

MIN_SIZE, MIN_PAGES, MIN_SHARE, MAX_LINKS = 2, 3, 0.5, 0.5
# Element names and class, id and role words.
RAW = "script|style|noscript|template|textarea|iframe|svg|title|select|object|canvas|math"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br td th".split())
OUT = set("nav footer aside form dialog menu button".split())
MAIN = {"article", "main"}
OUT_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar comment comments commentlist cookie cookies
notice consent newsletter subscribe share sharing social related breadcrumb breadcrumbs menu nav navbar navigation footer header masthead
widget popup modal disqus reply replies respond contentinfo complementary search toolbar pagination pager""".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*(?:>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][\w:-]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s\xa0]+")
Token = tuple[str, str, bool, bool, float]  # kind (tag or text), value, in the main element, left out, share of link characters


def read(page: str | None) -> list[Token]:
    """Tokens of a page in order. A block's text has its references decoded and its white space squeezed."""
    out: list[Token] = []
    stack: list[tuple[str, bool]] = []  # open elements; whether one leaves its content out
    left_out = mains = links = 0
    parts: list[str] = []
    link_chars = 0

    def block() -> None:
        nonlocal link_chars
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                out.append(("text", text, mains > 0, left_out > 0, min(1.0, link_chars / len(text))))
            parts.clear()
        link_chars = 0

    for m in TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            parts.append(text)
            link_chars += len(text) if links else 0
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if m["end"] or m["end2"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None and not (tag in INLINE and any(x[0] not in INLINE for x in stack[at:])):
                for name, off in stack[at:]:
                    left_out -= off
                    mains -= name in MAIN
                    links -= name == "a"
                del stack[at:]
            if tag not in INLINE:
                out.append(("tag", "/" + tag, mains > 0, left_out > 0, 0.0))
            continue
        named = [(a.lower(), b or c or d) for a, b, c, d in ATTR.findall(m["attrs"] or m["attrs2"] or "")]
        if tag in MAIN and left_out:  # an article inside something left open: that ended here
            mains = links = left_out = 0
            stack.clear()
        off = tag in OUT or tag == "header" and not mains
        off = off or tag not in MAIN | {"html", "body"} and any(w in OUT_WORDS for _, v in named for w in WORD.findall(v.lower()))
        if tag not in INLINE:
            out.append(("tag", " ".join([tag, *(f"{a}={v}" for a, v in named)]), mains > 0, left_out > 0 or off, 0.0))
        if tag not in VOID:
            if tag in ("p", "li", "tr", "dt", "dd", "option"):  # a new one ends the one before
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if at is not None and all(x[0] in INLINE or x[0] == tag for x in stack[at:]):
                    for name, o in stack[at:]:
                        left_out -= o
                        links -= name == "a"
                    del stack[at:]
            stack.append((tag, off))
            left_out += off
            mains += tag in MAIN
            links += tag == "a"
    block()
    return out


def code(token: Token) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{token[0]} {token[1]}".encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, token, count, first place, page) of the tokens outside main text; the text of articles is no template."""
    for frame in frames:
        rows = []
        for host, page, html in zip(frame["host"], frame["page"], frame["html"], strict=True):
            tokens = read(html)
            codes = [code(t) for t in tokens if t[0] == "tag" or not t[2]]
            places = {c: k for k, c in reversed(list(enumerate(codes)))}
            rows += [(host, c, n, places[c], page) for c, n in Counter(codes).items()]
        yield pd.DataFrame(rows, columns=["host", "token", "n", "place", "page"]).astype({c: "int64" for c in ("host", "token", "n", "place", "page")})


def templates(pages: DataFrame, url: str = "url", text: str = "html", min_size: int = MIN_SIZE, min_pages: int = MIN_PAGES,
              min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): the classes' tokens as an array of (support, times, class, mean place, token), most supported and, among
    those, least repeated first.

    host is the hash of the host's name. An occurrence vector is two sums of 32 bits of hash(page, count)."""
    keyed = pages.select(F.xxhash64(host_of(F.col(url))).alias("host"), F.xxhash64(F.col(text)).alias("page"), F.col(text).alias("html"))
    rows = keyed.mapInPandas(_vectors, "host long, token long, n long, place long, page long")
    h = F.xxhash64("page", "n")
    vector = F.struct(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"), F.sum(F.shiftrightunsigned(h, 32)).alias("b"))
    by = rows.groupBy("host", "token").agg(F.xxhash64(vector).alias("v"), F.count(F.lit(1)).alias("pages"), F.avg("place").alias("place"), F.sum("n").alias("times"))
    hosts = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    often = by.filter(F.col("pages") >= min_pages).join(hosts, "host").filter(F.col("pages") >= min_share * F.col("total"))
    classes = often.groupBy("host", "v", "pages", "times").agg(F.collect_list(F.struct("place", "token")).alias("members")).filter(F.size("members") >= min_size)
    flat = classes.select("host", "pages", "times", "v", F.explode("members").alias("m"))
    item = F.struct((-F.col("pages")).alias("support"), F.col("times"), F.col("v").alias("kind"), F.col("m.place").alias("place"), F.col("m.token").alias("token"))
    return flat.groupBy("host").agg(F.sort_array(F.collect_list(item)).alias("template"))


def nest(codes: list[int], template: list[tuple[int, int, int, float, int]]) -> set[int]:
    """Tokens of the template that are valid on a page: class by class, each in its order and in one slot of those placed before."""
    first: dict[int, int] = {}
    for k, c in enumerate(codes):
        first.setdefault(c, k)
    placed: list[int] = []
    valid: set[int] = set()
    groups: dict[tuple[int, int, int], list[int]] = {}
    for support, times, kind, _, token in template:
        groups.setdefault((support, times, kind), []).append(token)
    from bisect import bisect_left, insort

    for members in groups.values():
        at = [first.get(t) for t in members]
        if None in at or any(a >= b for a, b in zip(at, at[1:], strict=False)):
            continue
        if placed and bisect_left(placed, at[0]) != bisect_left(placed, at[-1]):
            continue
        valid.update(members)
        for a in at:
            insort(placed, a)
    return valid


def main_text(html: str | None, template: list[tuple[int, int, int, float, int]] | None = None) -> str:
    tokens = read(html)
    if any(t[0] == "text" and t[2] for t in tokens) or any(t[0] == "tag" and t[1].split(" ")[0] in MAIN for t in tokens):
        return "\n".join(t[1] for t in tokens if t[0] == "text" and t[2] and not t[3])
    codes = [code(t) for t in tokens]
    fixed = nest(codes, template) if template else set()
    return "\n".join(t[1] for t, c in zip(tokens, codes, strict=True) if t[0] == "text" and not t[3] and c not in fixed and t[4] <= MAX_LINKS)


def extract(pages: DataFrame, url: str = "url", html: str = "html", column: str = "text") -> DataFrame:
    """Every row without its html, with its main text."""
    found = written(templates(pages, url, html), "templates").withColumnsRenamed({"host": "_host", "template": "_template"})
    rows = pages.withColumn("_own", F.xxhash64(host_of(F.col(url))))
    rows = rows.join(found, F.col("_own") == F.col("_host"), "left")

    def texts(page: pd.Series, template: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(page, template, strict=True):
            items = None if t is None else [(x["support"], x["times"], x["kind"], x["place"], x["token"]) for x in t]
            out.append(main_text(p, items))
        return pd.Series(out, dtype=object)

    return rows.withColumn(column, F.pandas_udf("string")(texts)(F.col(html), F.col("_template"))).drop("_own", "_host", "_template", html)

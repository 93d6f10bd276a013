"""Operator 5: main text of HTML pages, with site templates removed.

A page is read into elements and text pieces. Elements that are never article text (scripts, styles, forms, menus,
headers outside the article, footers, asides, adverts, notices, comments: by tag, role, hidden state, or a name of
their class or id that says just this, such as "comments" or "share-buttons", but not "share-price" or "share-text"; reader comments also by their microdata) are left out with all
they hold. Only these attributes themselves are read, not what looks like one inside another's value or name. The content is all outermost ``article`` elements, else all outermost ``main``, else the body without menus made of links.

Site templates: every block element of the content gets the hash of its subtree (tag, text, children). Spark counts
each hash per host over distinct pages, copies of one page counting once, and a subtree that recurs on at least
``min_pages`` of a host's distinct pages and on ``share`` of them is deleted from all pages of that host. The counts are
a keyed sum, combined before its shuffle. Up to ``broadcast_templates`` template hashes are broadcast; beyond that they
are joined per host by a shuffle (a host has at most 1 / share times a page's subtrees of them).

Text: character references decoded, white space inside a block turned into one space, trimmed; blocks in page order,
joined by a newline. Defined cases: a null or empty page gives an empty text; unclosed elements end with their parent, a
stray end tag is ignored, an unclosed comment, script or style reaches to the end; a null url counts as a host of
its own name (empty); repeated rows are pages of their own but count once for templates.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .text import Tables, free, table

MIN_PAGES, SHARE, BROADCAST_TEMPLATES = 8, 0.5, 200_000
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^>]*+)>|<[!?][^>]*+>|<[A-Za-z/][^>]*+\Z""", re.DOTALL)
#: One attribute: its name and its value, which may hold anything between its quotes.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]*+))?|["'/=]""")
_TOLD = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop", "itemtype"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW = {n: re.compile(rf"</{n}\s*>?", re.IGNORECASE) for n in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset("head nav footer aside form script style select option button input textarea noscript iframe object embed applet canvas audio video map template dialog menu datalist fieldset title".split())
_ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("ul ol dl table article section div main body html aside nav footer form header blockquote".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_WORDS = frozenset("""nav navbar navigation menu submenu breadcrumb breadcrumbs masthead banner footer sidebar widget widgets ad ads advert adverts advertisement
    adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
    comment comments commentlist disqus respond reply replies related recommended recommendations share sharing social search pagination pager skip toolbar disclaimer hidden""".split())
#: What may stand beside such a word in a name that still says no more than it.
_BESIDE = frozenset("""area bar banner block body bottom box button buttons container content form group icon icons inner item items left link links list main outer page post posts primary right row section secondary site slot top unit wrap wrapper
    user users reader readers visitor visitors guest guests thread threads""".split())
_MASK = (1 << 64) - 1


def _excluded(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _NEVER or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    seen = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _TOLD or name in seen:  # of attributes of one name the first counts
            continue
        seen.add(name)
        value = references.unescape(value[1:-1] if value[:1] in ("'", '"') else value).lower()
        if name == "itemprop" and value == "comment" or name == "itemtype" and value.rstrip("/").rpartition("/")[2] in ("comment", "usercomments"):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = set(re.split(r"[^a-z]+", token)) - {""}
                own = words & _WORDS or not in_article and words & {"header"}
                if own and not words - own - _BESIDE and not words & {"layout"}:
                    return True
    return False


class Page:
    """Elements (parent, tag, subtree hash) and blocks of text pieces (element, text, inside a link)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.hash, self.filled = [-1], ["#page"], [0], [False]
        self.blocks: list[list[tuple[int, str, bool]]] = []
        self._piece: list[tuple[int, str, bool]] = []
        self._read(source)

    def _flush(self) -> None:
        if self._piece:
            self.blocks.append(self._piece)
            self._piece = []

    def _read(self, source: str) -> None:
        stack, skip, links, articles, at, size = [0], 0, 0, 0, 0, len(source)
        tags = self.tag
        # places in the stack by tag, of blocks and of scopes: no search through open elements
        places: dict[str, list[int]] = {}
        blocks, scopes = [0], [0]

        def text(piece: str) -> None:
            piece = references.unescape(piece) if "&" in piece else piece
            self._piece.append((stack[-1], piece, links > 0))
            own = " ".join(piece.split())
            if own:
                e = stack[-1]
                self.hash[e] = (self.hash[e] * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(own)) & _MASK
                self.filled[e] = True

        def leave(n: int) -> None:
            """Close elements until n are open."""
            nonlocal links, articles, skip
            while len(stack) > n:
                e = stack.pop()
                for known in (places[tags[e]], blocks, scopes):
                    if known[-1:] == [len(stack)]:
                        known.pop()
                if skip and len(stack) < skip:
                    skip = 0
                links -= tags[e] == "a"
                articles -= tags[e] in ("article", "main")
                if tags[e] in _BLOCK:
                    self._flush()
                if self.filled[e]:
                    p = stack[-1]
                    self.hash[p] = (self.hash[p] * 0xC2B2AE3D27D4EB4F + (self.hash[e] ^ self.hash[e] >> 29)) & _MASK
                    self.filled[p] = True

        while at < size:
            m = _TAG.search(source, at)
            stop = m.start() if m else size
            if stop > at and not skip:
                text(source[at:stop])
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                own = places.get(name)
                if own and (name in _BLOCK or own[-1] > blocks[-1]):
                    leave(own[-1])
                continue
            ends = _ENDS_ITSELF.get(name) or (_ENDS_ITSELF["p"] if name in _BLOCK else None)
            if ends:
                n = max((places[t][-1] for t in ends if places.get(t)), default=0)
                if n > scopes[-1]:
                    leave(n)
            if name in _VOID:
                if not skip and name == "hr":
                    self._flush()
                elif not skip and name == "br":
                    text(" ")
                continue
            if name in _RAW:
                end = _RAW[name].search(source, at)
                at = end.end() if end else size
                continue
            if name in _BLOCK:
                self._flush()
            elif name in ("td", "th") and not skip:
                text(" ")
            e = len(tags)
            self.parent.append(stack[-1])
            tags.append(name)
            self.hash.append(xxhash.xxh3_64_intdigest(name))
            self.filled.append(False)
            for known, wanted in ((places.setdefault(name, []), True), (blocks, name in _BLOCK), (scopes, name in _SCOPE)):
                if wanted:
                    known.append(len(stack))
            stack.append(e)
            links += name == "a"
            if not skip and _excluded(name, m[3], articles > 0):
                skip = len(stack)
            articles += name in ("article", "main")
            if m[3].endswith("/") and name not in _BLOCK:
                leave(len(stack) - 1)
        leave(1)
        self._flush()

    def roots(self) -> set[int]:
        """The content elements: outermost articles with text, else outermost mains, else the page."""
        above: list[tuple[int, int]] = [(0, 0)]  # outermost article and main of each element
        for e in range(1, len(self.parent)):
            article, main = above[self.parent[e]]
            above.append((article or e * (self.tag[e] == "article"), main or e * (self.tag[e] == "main")))
        held = {e for block in self.blocks for e, piece, _ in block if piece.strip()}
        for kind in (0, 1):
            found = {above[e][kind] for e in held} - {0}
            if found:
                return found
        return {0}

    def _within(self, roots: set[int]) -> list[bool]:
        out = [0 in roots] * len(self.parent)
        for e in range(1, len(self.parent)):
            out[e] = e in roots or out[self.parent[e]]
        return out

    def subtrees(self) -> set[int]:
        """Hashes of the block elements of the content that hold text, without the content elements themselves."""
        roots = self.roots()
        within = self._within(roots)
        return {h for e, h in enumerate(self.hash) if within[e] and e not in roots and self.filled[e] and self.tag[e] in _BLOCK}

    def text(self, templates: frozenset[int]) -> str:
        roots = self.roots()
        within = self._within(roots)
        for e in range(1, len(within)):
            if e not in roots and (not within[self.parent[e]] and within[e] or self.filled[e] and self.tag[e] in _BLOCK and self.hash[e] in templates):
                within[e] = False
        out = []
        for block in self.blocks:
            own = [(piece, link) for e, piece, link in block if within[e]]
            line = " ".join("".join(p for p, _ in own).split())
            if line and not (0 in roots and all(link or not p.strip() for p, link in own)):
                out.append(line)
        return "\n".join(out)


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.arrow_udf(T.StructType().add("page", T.LongType()).add("subtrees", T.ArrayType(T.LongType())))
def outlined(column: pa.Array) -> pa.Array:
    """A hash of the page's content and the hashes of its subtrees."""
    out = []
    for source in column:
        page = Page(source.as_py() or "")
        own = sorted(page.subtrees())
        out.append({"page": _signed(xxhash.xxh3_64_intdigest(repr(own))), "subtrees": [_signed(x) for x in own]})
    return pa.array(out, pa.struct([("page", pa.int64()), ("subtrees", pa.list_(pa.int64()))]))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, subtree) of the subtrees that recur; `pages` has the columns host, html. Each page is read once; counts of fewer pages aren't kept."""
    seen = pages.select("host", outlined("html").alias("o")).select("host", "o.page", F.explode(F.concat(F.array(F.lit(None).cast("long")), "o.subtrees")).alias("subtree"))
    counts = seen.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counts = Tables(pages.sparkSession).keep("counts", counts)
    whole = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    return counts.where("subtree is not null").join(whole, "host").where(F.col("n") >= share * F.col("pages")).select("host", "subtree")


def extract(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, share: float = SHARE, broadcast_templates: int = BROADCAST_TEMPLATES, out: str = "main_text") -> DataFrame:
    """`pages` with the main text in the column `out`, which is replaced if it is there."""
    host, given = free(pages, "host"), free(pages, "templates")
    own = pages.withColumn(host, F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1)))
    found = templates(own.select(F.col(host).alias("host"), F.col(html).alias("html")), min_pages, share)
    few = found.limit(broadcast_templates + 1).collect()
    if len(few) <= broadcast_templates:
        by_host: dict[str, set[int]] = {}
        for r in few:
            by_host.setdefault(r["host"], set()).add(r["subtree"] & _MASK)
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(s) for h, s in by_host.items()})

        @F.arrow_udf(T.StringType())
        def cleaned(sources: pa.Array, hosts: pa.Array) -> pa.Array:
            none: frozenset[int] = frozenset()
            return pa.array([Page(s.as_py()).text(shared.value.get(h.as_py(), none)) if s.as_py() else "" for s, h in zip(sources, hosts, strict=True)], pa.string())

        return own.withColumn(out, cleaned(F.col(html), host)).drop(host)

    @F.arrow_udf(T.StringType())
    def cleaned_by(sources: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([Page(s.as_py()).text(frozenset(x & _MASK for x in (own.as_py() or ()))) if s.as_py() else "" for s, own in zip(sources, lists, strict=True)], pa.string())

    lists = found.groupBy(F.col("host").alias(host)).agg(F.collect_set("subtree").alias(given))
    return own.join(lists, host, "left").withColumn(out, cleaned_by(F.col(html), given)).select(*[F.col(f"`{c}`") for c in pages.columns if c != out], out)


def op5(spark, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))

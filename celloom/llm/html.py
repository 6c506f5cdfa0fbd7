"""Main-text extraction: templates deduced from equivalence classes of tokens across a host's pages, then the slots that are left.

A token is an element at its path in the tag tree (names, classes and ids), or a block of text at such a path. Its occurrence vector
counts it on every page of the host; tokens with equal vectors form an equivalence class. A class is valid where its tokens come in
one order on every page and, for text, where it also holds elements, so that the text repeats with a skeleton. Elements of valid
classes whose ancestors are in valid classes too are nested into the host's template: its text is boilerplate, and each block of a
page that is left lies in the slot of the deepest template element around it.

The host's main slot is that with the most text outside links. What an element's name or class says of its role is weighed in, and
decides on the other slots: those of the page's frame (menus, adverts, forms ...) are not the article's.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celloom.llm.groups import hot_join
from celloom.llm.urls import host_of
from celloom.session import ship, small, stored

#: A class has support from so many different pages on that are at least this share of the host's; fewer are no evidence of a template.
LEAST_PAGES, LEAST_SHARE = 3, 0.5

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
FRAME = frozenset("head nav footer aside form script style textarea title iframe noscript xmp noembed noframes template svg math canvas object button select option dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
#: Words in class, id and role that mark parts of a page's frame.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    sidebar comment comments commentlist reply replies disqus respond nav navbar navigation menu breadcrumb breadcrumbs footer masthead widget related
    recommended share sharing social newsletter subscribe subscription popup modal overlay toolbar pagination pager login signup search contentinfo
    complementary dialog""".split()
)
#: Marks that count outside an article only.
OUTER_MARKS = frozenset(["header", "topbar", "heading-bar"])
#: Words that may stand beside a mark in one name; a name with any other word is not a mark.
AFFIXES = frozenset(
    """site page top bottom left right main outer inner box bar list wrap wrapper container block section area region item items slot unit panel
    group links link buttons button form primary secondary global user reader post article content text header head body js the my new""".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")

#: Roles of a block: beneath an element marked as frame by its names, in no such part, in an article or main element.
MARKED, PLAIN, INNER = 1, 2, 3
#: By how much a slot's text counts towards being the main slot.
WEIGHT = {MARKED: 0.1, PLAIN: 1.0, INNER: 10.0}
#: Most hosts whose facts, arrays of a page's size, are broadcast at once.
HOSTS = 10_000
#: A slot with at least so many blocks a page, at least this share of their characters in links, is a menu.
MENU_BLOCKS, MENU_SHARE = 3, 0.6


def marked(names: list[str], inside: bool) -> bool:
    """Whether one of an element's names is made of marks and affixes only."""
    for name in names:
        words = _WORD.findall(name)
        known = [w for w in words if w in MARKS or not inside and (w in OUTER_MARKS or name in OUTER_MARKS)]
        if known and all(w in MARKS or w in AFFIXES or w in OUTER_MARKS for w in words):
            return True
    return False


class Page:
    """A parsed page: blocks of text outside elements that hold no text of an article, elements with their parents, tokens in order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, int]] = []  # text, path, role, characters in links
        self.parents: dict[int, int] = {}  # of each path in order of appearance
        self.tokens: list[int] = []
        self._parse(source)

    def _parse(self, page: str) -> None:
        # name, path, framed, marked, in the main part
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        pieces: list[str] = []
        linked, anchors = 0, 0
        at, n = 0, len(page)

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                if text:
                    _, path, _, mark, main = stack[-1]
                    self.blocks.append((text, path, INNER if main and not mark else MARKED if mark else PLAIN, min(linked, len(text))))
                    self.tokens.append(text_token(text, path))
                pieces.clear()
            linked = 0

        def cut(depth: int):
            nonlocal anchors
            del stack[depth:]
            anchors = sum(s[0] == "a" for s in stack)

        while at < n:
            m = _TOKEN.search(page, at)
            end = m.start() if m else n
            if end > at and not stack[-1][2]:
                pieces.append(page[at:end])
                linked += (end - at) if anchors else 0
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    if tag not in INLINE or any(stack[i][0] not in INLINE for i in range(depth, len(stack))):
                        flush()
                    cut(depth)
                continue
            if tag not in INLINE:
                flush()
                if tag != "html" and any(s[0] == "p" for s in stack):
                    depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p")
                    if all(s[0] in INLINE for s in stack[depth + 1 :]):
                        cut(depth)
                if tag in ("li", "option", "td", "th", "tr", "dt", "dd"):
                    depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in (tag, "ul", "ol", "table", "dl", "select")), 0)
                    if depth and stack[depth][0] == tag:
                        cut(depth)
            elif tag == "br" and not stack[-1][2]:
                pieces.append(" ")
            _, parent, framed, mark, main = stack[-1]
            own = m[3] or ""
            found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(own)} if "=" in own else {}
            names = [x for k in ("class", "id", "role") if k in found for x in found[k].split()]
            label = f"{tag} {' '.join(_WORD.findall(' '.join(names)))}" if names else tag
            path = (parent * 1000003 + crc32(label.encode("utf-8", "replace"))) & 0x3FFFFFFFFFFFFFFF
            self.parents.setdefault(path, parent)
            self.tokens.append(path << 1)
            if tag in VOID:
                continue
            if own.endswith("/") and tag not in ("p", "div", "span", "a"):
                continue
            hidden = own and ("display:none" in found.get("style", "").replace(" ", "") or found.get("aria-hidden") == "true" or "hidden" in own and _HIDDEN.search(_ATTRIBUTE.sub(" ", own)))
            framed = bool(framed or tag in FRAME or tag == "header" and not main or hidden)
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                at = (page.find(">", close.start()) + 1 or n) if close else n
                continue
            mark = mark or bool(names) and tag not in MAIN and tag not in ("html", "body") and marked(names, main)
            stack.append((tag, path, framed, mark, main or tag in MAIN))
            anchors += tag == "a"
        flush()

    def content(self) -> bytes:
        """What pages that are copies of each other share: their text outside the frame."""
        return "\n".join(b[0] for b in self.blocks if b[2] != MARKED).encode("utf-8", "surrogatepass")


def text_token(text: str, path: int) -> int:
    return int.from_bytes(blake2b(f"{path} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) | 1


def slots_of(parents: dict[int, int], template: set[int]) -> dict[int, int]:
    """The slot of each path: the deepest element around it that is nested in the template, 0 for none."""
    nested, out = {0: True}, {0: 0}
    for path, parent in parents.items():
        nested[path] = nested[parent] and path << 1 in template
        out[path] = path if nested[path] else out[parent]
    return out


def judge_slots(rows: list[tuple[int, int, int, int, int]], pages: int) -> tuple[tuple[int, int] | None, set[tuple[int, int]]]:
    """The main slot and the menus among a host's slots (slot, role, characters, characters in links, blocks) over so many pages.

    The main slot has the greatest weighted number of characters outside links; ties go to the stronger role, then the lower slot.
    """
    held = [(WEIGHT[role] * (chars - links), role, -slot) for slot, role, chars, links, _ in rows]
    main = max(held, default=None)
    main = (-main[2], main[1]) if main else None
    menus = {(slot, role) for slot, role, chars, links, blocks in rows if role == PLAIN and (slot, role) != main and blocks >= MENU_BLOCKS * pages and links >= MENU_SHARE * chars}
    return main, menus


def main_text(page: Page, template: set[int], main: tuple[int, int] | None, menus: set[tuple[int, int]]) -> str:
    """The blocks that are the article's, joined by line ends.

    Blocks in an article or main element are, where a page has them, also if the template repeats them. Else those that are not the
    template's text, in slots that are no menus; where the main slot is marked as frame its blocks are among them. A page that has
    nothing else gives its marked blocks.
    """
    inner = [b[0] for b in page.blocks if b[2] == INNER]
    if inner:
        return "\n".join(inner)
    slots = slots_of(page.parents, template)
    rest = [(text, (slots[path], role)) for text, path, role, _ in page.blocks if text_token(text, path) not in template]
    own = [text for text, slot in rest if slot == main or slot[1] == PLAIN and slot not in menus]
    return "\n".join(own or [text for text, _ in rest])


def skeletons(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(row, host, content, tokens, paths, parents, s_path, s_role, s_chars, s_links, s_blocks) of each page, stored: its tokens in
    order, its elements, and sums over its blocks of one path and role."""
    ship(pages.sparkSession)
    held = pages.select(F.monotonically_increasing_id().alias("row"), F.col(host).alias("host"), F.col(html).alias("html"))
    arrays = ["paths", "parents", "s_path", "s_role", "s_chars", "s_links", "s_blocks"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, own, source in zip(batch.row, batch.host, batch.html, strict=True):
                page = Page(source)
                sums: dict[tuple[int, int], list[int]] = {}
                for text, path, role, links in page.blocks:
                    s = sums.setdefault((path, role), [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + len(text), s[1] + links, s[2] + 1
                content = int.from_bytes(blake2b(page.content(), digest_size=8, key=int(own).to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                columns = [list(page.parents), list(page.parents.values()), [p for p, _ in sums], [r for _, r in sums], *([s[i] for s in sums.values()] for i in range(3))]
                out.append((row, own, content, *[np.array(x, np.int64).tobytes() for x in (page.tokens, *columns)]))
            yield pd.DataFrame(out, columns=["row", "host", "content", "tokens", *arrays])

    return stored(held.mapInPandas(run, f"row long, host long, content long, tokens binary, {', '.join(f'{a} binary' for a in arrays)}"), "html-skeletons")


def representatives(pages: DataFrame) -> DataFrame:
    """One row of skeletons() for each different content of a host, so that copies count as one page."""
    contents = stored(pages.groupBy("content").agg(F.min("row").alias("first"), F.count("*").alias("n")), "html-contents")
    copied = contents.where("n > 1")
    if not copied.limit(1).count():
        return pages
    gone = stored(hot_join(pages.select("row", "content"), stored(copied, "html-copied"), "content").where("row != first").select("row"), "html-copies")
    return pages.join(small(gone), "row", "left_anti")


def templates(pages: DataFrame) -> DataFrame:
    """(host, of, template) for each host of representatives(): its number of pages and the tokens of its template.

    Vectors are compared by their sums of two hashes of (page, count), and the order of a class by what precedes each of its
    tokens: the class's last element, for an element the last one with its own parent. So all grouping is done by partial aggregates.
    The tokens with support are at most as many as a host's pages have on average, over LEAST_SHARE.
    """
    sizes = pages.groupBy("host").agg(F.count("*").alias("of"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.unique(np.frombuffer(t, np.int64), return_counts=True) for t in batch.tokens]
            of = [len(t) for t, _ in own]
            yield pd.DataFrame({"host": np.repeat(batch.host.to_numpy(), of), "page": np.repeat(batch.content.to_numpy(), of), "token": np.concatenate([np.zeros(0, np.int64), *(t for t, _ in own)]), "n": np.concatenate([np.zeros(0, np.int64), *(c for _, c in own)])})

    counted = pages.select("host", "content", "tokens").mapInPandas(count, "host long, page long, token long, n long")
    half = lambda salt: F.shiftrightunsigned(F.xxhash64("page", "n", F.lit(salt)), 32)
    vectors = counted.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(half(1)).alias("v1"), F.sum(half(2)).alias("v2")).where(F.col("pages") >= LEAST_PAGES)
    vectors = stored(vectors, "html-vectors")
    sizes = stored(sizes.select("host", "of", F.col("of").alias("n")), "html-hosts")
    held = hot_join(vectors, sizes, "host").where(F.col("pages") >= F.lit(LEAST_SHARE) * F.col("of"))
    classes = held.groupBy("host", F.xxhash64("pages", "v1", "v2").alias("class")).agg(F.collect_list("token").alias("tokens")).where(F.exists("tokens", lambda t: t % 2 == 0))
    listed = classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("known"), F.flatten(F.collect_list(F.transform("tokens", lambda t: F.col("class")))).alias("classes"))
    listed = stored(sizes.join(listed, "host").select("host", "known", "classes", "n"), "html-classes")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[int, int, int], None] = {}
            for host, tokens, paths, parents, known, classes in zip(*(batch[c] for c in ("host", "tokens", "paths", "parents", "known", "classes")), strict=True):
                of = dict(zip(np.asarray(known).tolist(), np.asarray(classes).tolist(), strict=True))
                around = dict(zip(np.frombuffer(paths, np.int64).tolist(), np.frombuffer(parents, np.int64).tolist(), strict=True))
                last: dict[tuple, int] = {}
                first: list[tuple[tuple, int]] = []
                for t in np.frombuffer(tokens, np.int64).tolist():
                    own = of.get(t)
                    if own is None:
                        continue
                    key = (own,) if t & 1 else (own, around[t >> 1])
                    if key in last:
                        out[host, t, last[key]] = None
                    else:
                        first.append((key, t))
                    if not t & 1:
                        last[key] = last[own,] = t
                for key, t in first:  # what comes before the first element follows the last one, in a ring
                    out[host, t, last.get(key, 0)] = None
            yield pd.DataFrame(list(out), columns=["host", "token", "before"])

    followed = hot_join(pages.select("host", "tokens", "paths", "parents"), listed, "host", HOSTS).mapInPandas(follow, "host long, token long, before long")
    ordered = followed.groupBy("host", "token").agg(F.min("before").alias("a"), F.max("before").alias("b")).where("a = b")
    found = ordered.groupBy("host").agg(F.collect_list("token").alias("template"))
    return stored(sizes.join(found, "host", "left").select("host", "of", F.coalesce("template", F.array().cast("array<long>")).alias("template"), "n"), "html-templates")


def slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, slots): for each host of templates() the sums over the blocks of each slot and role."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            for r in batch.itertuples(index=False):
                read = lambda x: np.frombuffer(x, np.int64).tolist()
                of = slots_of(dict(zip(read(r.paths), read(r.parents), strict=True)), set(np.asarray(r.template).tolist()))
                for path, role, *own in zip(*map(read, (r.s_path, r.s_role, r.s_chars, r.s_links, r.s_blocks)), strict=True):
                    key = (r.host, of[path], role)
                    sums[key] = sums.get(key, 0) + np.array(own)
            yield pd.DataFrame([(*k, *map(int, v)) for k, v in sums.items()], columns=["host", "slot", "role", "chars", "links", "blocks"])

    summed = hot_join(pages.drop("row", "content", "tokens"), found.drop("of"), "host", HOSTS).mapInPandas(run, "host long, slot long, role long, chars long, links long, blocks long")
    summed = summed.groupBy("host", "slot", "role").agg(*[F.sum(c).alias(c) for c in ("chars", "links", "blocks")])
    return summed.groupBy("host").agg(F.collect_list(F.struct("slot", "role", "chars", "links", "blocks")).alias("slots"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """The columns in keep with text (the main text: blocks joined by line ends; empty if there is none) and n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space. Null html is an empty page; a null url belongs to
    the host without a name. Repeated pages, or pages that are copies of each other but for their frame, give rows of their own, but
    count as one page of their host. Nothing is capped: a page or block of any length stays whole. An empty table gives an empty one.
    Other columns are ignored, whatever their names.
    """
    ship(pages.sparkSession)
    held = pages.select(*keep, F.xxhash64(host_of(F.col(url))).alias("__host"), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    every = skeletons(held, "__host", "__html")
    once = representatives(every)
    found = templates(once)
    rows = stored(every.groupBy("host").agg(F.count("*").alias("n")), "html-rows")
    facts = found.drop("n").join(slots(once, found), "host", "left").join(rows, "host").withColumnsRenamed({"host": "__host", "of": "__of", "template": "__template", "slots": "__slots"})
    held = hot_join(held, stored(facts, "html-facts"), "__host", HOSTS)
    own = [c for c in held.columns if not c.startswith("__") or c in keep]
    schema = T.StructType(held.select(*keep).schema.fields + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, known = [], {}
            for host, source, of, template, rows in zip(*(batch[f"__{c}"] for c in ("host", "html", "of", "template", "slots")), strict=True):
                if host not in known:
                    told = [] if rows is None else [(r["slot"], r["role"], r["chars"], r["links"], r["blocks"]) for r in rows]
                    known[host] = (set(np.asarray(template).tolist()), *judge_slots(told, int(of)))
                texts.append(main_text(Page(source), *known[host]))
            yield batch[own].assign(text=texts, n_chars=[len(t) for t in texts])

    return held.mapInPandas(run, schema)

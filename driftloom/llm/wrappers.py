"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of block tags and text slots. Repeats that stand side by side become a repeated
group; then pages of one host are aligned one after the other with the wrapper so far: texts that
differ turn a slot into a variable one, tags that one side lacks become an optional group. The
result is a regular expression without unions, such as `body ( nav ( ul ( li # )+ )? article ...`.

Inference is spread: a task folds its own pages into one wrapper per host, then the wrappers of a
host, one per task, are aligned with each other. A host of any size sends one row per task.

The wrapper gives the region that holds the article: the innermost block element with all of the
text that is not template and lies outside menus, headers, footers, sidebars, notices, adverts,
forms and comments. Text slots whose text is the same on all pages are part of the template and go,
and so do lists of links outside the region. Nothing else goes. A host has a template if three of its
pages differ from each other in most of their text; copies and revisions of a page do not count. That
is seen on a sample that does not depend on order: pages with the smallest digests, and those with the
smallest hashes in their longest text.
Texts are compared whole, by digest, and a page's texts with those at the same place of the wrapper.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by one space in page order. Inline tags add nothing, line breaks and block tags a space. Null and
empty pages give an empty text. A null url is a host of its own. Repeated rows give equal texts;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.scratch import Scratch, checked_broadcast

_QUOTED = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|textarea|select)\b{_QUOTED}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_QUOTED})>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
OUTSIDE = frozenset("nav footer aside form button head title menu dialog object canvas audio video".split())
#: Words of class, id and role that mark such parts (fixed values). A compound such as
#: `cookie-notice` marks one if all of its words do; `has-sidebar` does not.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer form hidden login menu modal nav "
    "navbar navigation newsletter notice notices popup promo promoted related replies respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
#: One attribute: its name and, if it has one, its value with the quotes.
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")
_TOKEN = re.compile(r"[a-z0-9_-]+")
#: Elements that hold one text and are no region.
_TEXT = re.compile(r"(p|li|td|h\d|pre|blockquote|dd|dt)\b")


class Block:
    """One text block of a page: path of block elements, text, characters in links, outside or not."""

    __slots__ = ("path", "text", "linked", "outside")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, outside: bool):
        self.path, self.text, self.linked, self.outside = path, text, linked, outside

    @property
    def size(self) -> int:
        """Characters of text, none if half of them are in links."""
        return max(0, len(self.text) - 2 * self.linked)

    @property
    def token(self) -> str:
        """The text if it is short, else its digest, which is longer than a short text."""
        if len(self.text) <= 64:
            return self.text
        return "\0" + hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=32).hexdigest()


def _marked(token: str) -> bool:
    """Whether a whole token of class, id or role marks a part that is no article."""
    names = _NAME.findall(token) if _TOKEN.fullmatch(token) else []
    return bool(names) and MARKS.issuperset(names)


def _label(name: str, attributes: str) -> tuple[str, bool, bool]:
    """Name of an element with its class; whether class, id or role mark it as no article; whether it
    is hidden."""
    if not attributes or attributes.isspace():
        return name, False, False
    bad, hidden, classes = False, False, []
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            bad = bad or any(map(_marked, value.split()))
            if key == "class":
                classes = sorted(re.sub(r"\d+", "0", c) for c in value.split())[:2]
        elif key == "hidden":
            hidden = hidden or value != "false"
        elif key == "aria-hidden":
            hidden = hidden or value == "true"
    bad = bad and name not in ("body", "html", "main", "article")
    return ".".join([name, *classes]), bad, hidden


def parse(page: str | None) -> tuple[list[str], list[Block]]:
    """Stream of block tags (`name`, `/name`) and `#`, and the text blocks behind each `#`."""
    stream: list[str] = []
    blocks: list[Block] = []
    # name, label, outside for good, numbers of the marked elements around
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []
    around: list[tuple[int, ...]] = []  # the same numbers for each block
    titled: set[int] = set()  # marked elements that hold a main heading
    marks = 0
    words: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            stream.append("#")
            blocks.append(Block(tuple(s[1] for s in stack), text, linked, bool(stack) and stack[-1][2]))
            around.append(stack[-1][3] if stack else ())
        linked = 0

    def pop_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            stream.append("/" + stack.pop()[1])

    page = page or ""
    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            words.append(text)
            if links:
                linked += len(text.strip())
        at = m.end()
        name = m.group(3) or m.group(6)
        if not name:
            continue
        name = name.lower()
        closing = m.group(2) or m.group(5)
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                words.append(" ")
            else:
                pop_to(depth)
            links = 0
            continue
        if name in VOID:
            words.append(" ")
            if name == "hr":
                flush()
            continue
        flush()
        links = 0
        closes = CLOSES.get(name)
        if name == "body":
            pop_to(1 if stack and stack[0][0] == "html" else 0)
        elif closes:
            limit = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in limit:
                    break
                if stack[i][0] in closes:
                    pop_to(i)
                    break
        elif stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        label, marked, hidden = _label(name, m.group(4) or m.group(7) or "")
        inner = any(s[0] in ("article", "main") for s in stack)
        bad = hidden or name in OUTSIDE or (name == "header" and not inner) or bool(stack and stack[-1][2])
        within = stack[-1][3] if stack else ()
        if marked:
            within = (*within, marks)
            marks += 1
        if name in ("h1", "main"):
            titled.update(within)
        if name != "html":
            stack.append((name, label, bad, within))
            stream.append(label)
    if at < len(page):
        words.append(page[at:])
    pop_to(0)
    # A mark does not count on an element that holds a main heading and most of a page's text.
    held: Counter = Counter()
    for block, within in zip(blocks, around, strict=True):
        if not block.outside:
            held.update(dict.fromkeys(within, block.size))
    most = sum(b.size for b in blocks if not b.outside) / 2
    real = {k for k in range(marks) if k not in titled or held[k] <= most}
    for block, within in zip(blocks, around, strict=True):
        block.outside = block.outside or not real.isdisjoint(within)
    return stream, blocks


# A wrapper is a list of items: a tag (str); a slot ["#", token of the text or None]; a repeated
# group ["+", items]; an optional group ["?", items]. In a page's own items a slot may also hold the
# numbers of its blocks, as a list.


def key(item) -> str:
    """What two items must agree on to be aligned; texts do not matter."""
    if isinstance(item, str):
        return item
    return item[0] if item[0] == "#" else item[0] + "(" + " ".join(key(x) for x in item[1]) + ")"


def repeats(items: list, longest: int = 48) -> list:
    """Runs of equal neighbours that are whole elements become repeated groups, inner ones first."""
    period = 1
    while period <= min(longest, len(items)):
        keys = [key(x) for x in items]
        out: list = []
        i = 0
        found = False
        while i < len(items):
            unit = items[i : i + period]
            n = 1
            if _element(unit):
                while keys[i + n * period : i + (n + 1) * period] == keys[i : i + period]:
                    n += 1
            if n > 1:
                merged = unit
                for k in range(1, n):
                    merged = [_same(a, b) for a, b in zip(merged, items[i + k * period : i + (k + 1) * period])]
                out.append(["+", merged])
                i += n * period
                found = True
            else:
                out.append(items[i])
                i += 1
        items = out
        period = 1 if found else period + 1
    return _absorb(items)


def _element(unit: list) -> bool:
    """A unit to repeat is one whole element."""
    first, last = unit[0], unit[-1]
    return len(unit) > 1 and isinstance(first, str) and last == "/" + first


def _absorb(items: list) -> list:
    """A single element next to its own repeated group joins the group."""
    out: list = []
    for item in items:
        out.append(item)
        while len(out) > 1:
            one, group = out[-1], out[-2]
            if isinstance(group, list) and group[0] == "+" and isinstance(one, list) and one[0] == "+" and key(one) == key(group):
                out[-2:] = [["+", [_same(a, b) for a, b in zip(group[1], one[1])]]]
                continue
            break
    return out


def _same(a, b):
    """Two items with one key: texts that differ make a variable slot."""
    if isinstance(a, str):
        return a
    if a[0] == "#":
        if isinstance(a[1], list):
            return ["#", a[1] + b[1]]
        return ["#", a[1] if a[1] == b[1] else None]
    return [a[0], [_same(x, y) for x, y in zip(a[1], b[1])]]


def _bare(item):
    """An optional or repeated group and its plain content can be aligned."""
    return item[1] if isinstance(item, list) and item[0] in "+?" else None


def align(a: list, b: list) -> list:
    """The smallest common wrapper found by longest common subsequence."""
    if [key(x) for x in a] == [key(x) for x in b]:
        return [_same(x, y) for x, y in zip(a, b)]
    out: list = []
    only_a: list = []
    only_b: list = []

    def close() -> None:
        for extra in (only_a, only_b):
            if extra:
                plain = extra[0] if len(extra) == 1 and isinstance(extra[0], list) and extra[0][0] == "?" else ["?", list(extra)]
                out.append(plain)
                extra.clear()

    for x, y in _matched(a, b):
        if x is not None and y is not None:
            close()
            out.append(_same(x, y))
        elif x is not None:
            only_a.append(x)
        else:
            only_b.append(y)
    close()
    return _absorb(out)


def _matched(a: list, b: list):
    """Items of both sides in order: (item, item) that agree, (item, None) and (None, item) that do not."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        yield from zip(a, b)
        return
    # optional groups of either side may match the other's content
    a = [y for x in a for y in (_opened(x, kb))]
    b = [y for x in b for y in (_opened(x, [key(z) for z in a]))]
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[i] == kb[j]:
            yield a[i], b[j]
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            yield a[i], None
            i += 1
        else:
            yield None, b[j]
            j += 1


def places(page: list, wrapper: list) -> dict[int, str]:
    """Token that the wrapper has at the place of a page's block, by the block's number."""
    out: dict[int, str] = {}
    for x, y in _matched(page, wrapper):
        if not isinstance(x, list) or not isinstance(y, list) or y[0] == "?":
            continue
        if x[0] == "#":
            if y[1] is not None:
                out.update(dict.fromkeys(x[1], y[1]))
        else:
            out.update(places(x[1], y[1]))
    return out


def _opened(item, other: list[str]) -> list:
    """An optional group whose parts the other side has stands open; the parts are optional then."""
    inner = _bare(item)
    if inner is None or item[0] != "?" or key(item) in other:
        return [item]
    keys = [key(x) for x in inner]
    if any(other[i : i + len(keys)] == keys for i in range(len(other) - len(keys) + 1)):
        return inner
    return [item]


def page_wrapper(stream: list[str], blocks: list[Block]) -> list:
    texts = iter(blocks)
    return repeats([["#", next(texts).token] if s == "#" else s for s in stream])


def page_places(stream: list[str]) -> list:
    """Like `page_wrapper`, with the numbers of the blocks in the slots."""
    numbers = itertools.count()
    return repeats([["#", [next(numbers)]] if s == "#" else s for s in stream])


#: Pages in each half of a host's sample, and hashes of each of them (fixed values).
SAMPLE, HASHES = 8, 32


def _hashes(text: str) -> list[int]:
    """The smallest hashes of the runs of three words."""
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split()], np.uint64)
    n = max(1, len(words) - 2)
    runs = words[:n].copy()
    for k in (1, 2):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) ^ (runs >> np.uint64(29))
        runs += words[k : k + n] if len(words) >= 3 else words[k : k + 1].sum()
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(runs >> np.uint64(32))[:HASHES].tolist()


def _differ(a: list[int], b: list[int]) -> bool:
    """Whether two pages differ in most of their text: at most a third of the runs of both is shared."""
    both = sorted({*a, *b})[:HASHES]
    return 3 * len({*a} & {*b} & {*both}) <= len(both)


class Folded:
    """Wrapper of some pages of a host, with what its regions and texts hold.

    `sample` has two halves, each with the page [digest, hashes] of a key for the smallest keys.
    """

    def __init__(self, wrapper: list, pages: int, mass: Counter, sample: list[dict[str, list]]):
        self.wrapper, self.pages, self.mass, self.sample = wrapper, pages, mass, sample

    @classmethod
    def of(cls, page: str | None) -> Folded:
        stream, blocks = parse(page)
        mass: Counter = Counter()
        for b in blocks:
            if not b.outside and b.size:
                mass[" ".join(b.path)] += b.size
        texts = [b.text for b in blocks if not b.outside and b.size]
        sample: list[dict[str, list]] = [{}, {}]
        if texts:
            whole = "\n".join(texts)
            name = hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            held = [name, _hashes(whole)]
            sample = [{name: held}, {f"{_hashes(max(texts, key=len))[0]:08x}": held}]
        return cls(page_wrapper(stream, blocks), 1, mass, sample)

    def merge(self, other: Folded) -> None:
        if self.wrapper != other.wrapper:
            self.wrapper = align(self.wrapper, other.wrapper)
        for own, more in zip(self.sample, other.sample):
            for k, page in more.items():
                own[k] = min(own.get(k, page), page)
            for k in sorted(own)[SAMPLE:]:
                del own[k]
        self.pages += other.pages
        self.mass.update(other.mass)
        # paths of odd pages do not pile up: the deepest ones count for their parents
        while len(self.mass) > 4096:
            deepest = max(k.count(" ") for k in self.mass)
            less: Counter = Counter()
            for k, v in self.mass.items():
                less[k.rpartition(" ")[0] if k.count(" ") == deepest else k] += v
            self.mass = less

    def to_row(self) -> dict:
        return {"wrapper": json.dumps(self.wrapper), "pages": self.pages, "mass": json.dumps(self.mass), "sample": json.dumps(self.sample)}

    @classmethod
    def from_row(cls, wrapper: str, pages: int, mass: str, sample: str) -> Folded:
        return cls(json.loads(wrapper), pages, Counter(json.loads(mass)), json.loads(sample))

    def varied(self) -> bool:
        """Whether three pages differ from each other in most of their text."""
        pages = [p[1] for _, p in sorted({p[0]: p for half in self.sample for p in half.values()}.items())]
        near = [[j for j in range(i + 1, len(pages)) if _differ(pages[i], pages[j])] for i in range(len(pages))]
        return any(not set(near[i]).isdisjoint(near[j]) for i in range(len(pages)) for j in near[i])

    def rule(self) -> dict:
        """Region of the article and the template texts inside it."""
        fixed = sorted(_fixed_texts(self.wrapper)) if self.varied() else []
        constant = _constant_paths(self.wrapper) if fixed else set()
        paths = [k.split() for k, size in self.mass.items() if size and k not in constant]
        region = os.path.commonprefix(paths)
        while region and _TEXT.match(region[-1]):
            region = region[:-1]
        return {"region": " ".join(region), "fixed": fixed, "wrapper": self.wrapper if fixed else []}


def _fixed_texts(items: list) -> set[str]:
    """Texts that every page has in the same place of the wrapper."""
    out = set()
    for item in items:
        if isinstance(item, list):
            if item[0] == "#" and item[1] is not None:
                out.add(item[1])
            elif item[0] == "+":
                out |= _fixed_texts(item[1])
    return out


def _constant_paths(items: list) -> set[str]:
    """Paths all of whose slots have a text that every page has."""
    slots: dict[str, bool] = {}
    stack: list[str] = []

    def walk(items: list, always: bool) -> None:
        for item in items:
            if isinstance(item, list):
                if item[0] == "#":
                    path = " ".join(stack)
                    slots[path] = slots.get(path, True) and always and item[1] is not None
                else:
                    walk(item[1], always and item[0] == "+")
            elif not item.startswith("/"):
                stack.append(item)
            elif item[1:] in stack:
                while stack.pop() != item[1:]:
                    pass

    walk(items, True)
    return {path for path, constant in slots.items() if constant}


def main_text(page: str | None, rule: dict | None) -> str:
    """Text blocks of the article of one page, joined by one space."""
    stream, found = parse(page)
    blocks = [b for b in found if not b.outside]
    if rule:
        region = tuple(rule["region"].split())
        inside = [b for b in blocks if b.path[: len(region)] == region]
        fixed = set(rule["fixed"])
        # only a page that holds such a text has to be aligned
        known = places(page_places(stream), rule["wrapper"]) if any(b.token in fixed for b in blocks) else {}
        gone = {id(found[i]) for i, token in known.items() if found[i].token == token}
        own = [b for b in blocks if (b.size or b.path[: len(region)] == region) and id(b) not in gone]
        blocks = own or inside or blocks
    return " ".join(b.text for b in blocks)


def host_of(url) -> F.Column:
    """Lower-case host of a url, empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return host


_ROW = "host string, wrapper string, pages long, mass string, sample string"


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages, mass, sample) of pages (host, html)."""

    def fold(batches):
        held: dict[str, Folded] = {}
        for b in batches:
            hosts = b.column("host").to_pylist()
            for host, page in zip(hosts, b.column("html").to_pylist()):
                new = Folded.of(page)
                if host in held:
                    held[host].merge(new)
                else:
                    held[host] = new
        rows = [{"host": h, **f.to_row()} for h, f in held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in (
                ("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64()), ("mass", pa.string()), ("sample", pa.string()))],
            names=["host", "wrapper", "pages", "mass", "sample"],
        )

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "wrapper"], ascending=[False, True])
        parts = [Folded.from_row(*r) for r in rows[["wrapper", "pages", "mass", "sample"]].itertuples(index=False)]
        for p in parts[1:]:
            parts[0].merge(p)
        return pd.DataFrame([{"host": key[0], **parts[0].to_row()}])

    return pages.mapInArrow(fold, _ROW).groupBy("host").applyInPandas(join, _ROW)


def extract(pages: DataFrame, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html).

    The hosts' rules are broadcast if they take at most `broadcast_bytes` altogether; more rules
    are joined to the pages by host.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    pages = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))

    def ruled(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("host", "wrapper", "pages", "mass", "sample")]
            rules = [json.dumps(Folded.from_row(*r[1:]).rule()) for r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(rules, pa.string())], names=["host", "rule"])

    rules = scratch.write(infer(pages).mapInArrow(ruled, "host string, rule string"), "rules")
    size = rules.agg(F.sum(F.length("rule") + F.length("host") + 64)).first()[0] or 0
    schema = "page_id long, url string, text string"
    if size <= broadcast_bytes:
        held = {r["host"]: json.loads(r["rule"]) for r in rules.collect()}
        shared = checked_broadcast(pages.sparkSession, held, size, broadcast_bytes)
    else:
        shared = None
        pages = pages.join(rules, "host")

    def run(batches):
        for b in batches:
            if shared is not None:
                own = [shared.value.get(h) for h in b.column("host").to_pylist()]
            else:
                own = map(json.loads, b.column("rule").to_pylist())
            texts = [main_text(p, r) for p, r in zip(b.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return pages.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, schema)

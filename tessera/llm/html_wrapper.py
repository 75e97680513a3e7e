"""HTML main-text extraction by union-free wrapper inference.

The pages of a host are aligned one after another: a page's tag stream is read into
nested items; neighbouring equal items become one repeated item (also runs of two or
three that recur), items that only one side has become optional, and text becomes
slots. Because aligning two wrappers works like aligning a wrapper and a page, every
task folds the pages it reads into one wrapper a host, those are merged in two steps,
and no task ever holds a host's pages. Each slot carries how many pages fill it, how
much text and link text it held, and whether that text ever varied.

A host's wrapper decides what is article text. Where: its article or main element, else
the element that holds most of the varying text outside links. What there: a slot whose
text never varied and that the expression has on every page, once, is the template's and
left out, if varying text outweighs such text (copies of an article are no template);
constant text in optional or repeated items stays. Elements, roles and whole class names
of menus, headers, footers, sidebars, notices, adverts, forms and comments are left out;
where only a part of a class name or an id says so, or a name inside an article that its
own parts can have too (DOUBTFUL), the wrapper decides: a slot that never varied, or that
holds mostly links, is left out.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import write_scratch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
#: Elements, words of class or id, and roles that are never article text.
LEFT_OUT = RAW | frozenset("head nav footer aside form button select option menu dialog input fieldset legend datalist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted popup modal overlay lightbox interstitial cookie cookies consent gdpr notice notification alert "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc skip toolbar header masthead topbar footer foot colophon copyright sidebar aside rail widget widgets related recommended recommendations "
    "more-from share sharing social follow newsletter subscribe subscription signup login search comment comments commentlist disqus respond reply replies discussion feedback".split()
)
#: Of these, names that a part of an article can have too; inside an article the wrapper decides on them.
DOUBTFUL = frozenset("promotion overlay banner alert notification skip header foot toc rail widget related recommended recommendations follow search respond reply replies discussion feedback".split())
#: Elements whose names count: containers, not paragraphs.
NAMED = frozenset("div section ul ol dl table figure center details span".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MAIN_NAMES = frozenset("main-content maincontent article-body articlebody article-content entry-content post-content post-body story-body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements nested deeper belong to the one at this depth; no text is lost.
DEEPEST = 64
#: Pages a host needs before a text that never varied counts as the template's, and the link share of a menu.
FIXED_PAGES, LINKED = 3, 0.5
#: Labels that are compared one by one by a whole table; longer runs are anchored.
TABLE = 40_000
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _label(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """A tag's label (with class and id, words with digits blanked), whether it is left out, is so outside an article, may be, or names the article."""
    if not attributes.strip():
        return tag, tag in LEFT_OUT, False, False, tag in ("article", "main")
    out, doubt, maybe, main, names = tag in LEFT_OUT, False, False, tag in ("article", "main"), []
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            words = value.split()
            names += [re.sub(r"[a-z0-9]*\d[a-z0-9]*", "0", w) for w in words]
            parts = {p for w in words if not re.match(r"(with|without|has|no)[-_]", w) for p in re.split(r"[-_]+", w)}
            main |= not MAIN_NAMES.isdisjoint(words)
            if tag in NAMED and MAIN_NAMES.isdisjoint(words):
                out |= not (NAMES - DOUBTFUL).isdisjoint(words)
                doubt |= not DOUBTFUL.isdisjoint(words)
                maybe |= not NAMES.isdisjoint(parts)
        elif key == "role":
            out |= value in ROLES
            main |= value in ("main", "article")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out = True
    return ".".join([tag, *sorted(set(names))]).replace("/", "_"), out, doubt, maybe and not out, main


class Page:
    """A page's nested items and its text pieces: (path, text, block number, inside a link)."""

    def __init__(self, source: str):
        self.root: list = ["", "1", []]
        self.texts: list[tuple[str, str, int, bool]] = []
        # of each open element: tag, label path, left out, children, inside a link
        stack = [("", "", False, self.root[2], False)]
        block, at, size = 0, 0, len(source)

        def text(upto: int) -> None:
            piece = source[at:upto]
            _, path, out, children, link = stack[-1]
            if not out and piece and not piece.isspace():
                self.texts.append((path, html.unescape(piece), block, link))
                if not children or children[-1][0] != "#":
                    children.append(["#", "1", []])
            elif not out and piece:
                self.texts.append((path, " ", block, link))

        while (m := _TOKEN.search(source, at)) is not None:
            text(m.start())
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                block += tag not in INLINE
                continue
            if tag == "br":
                self.texts.append((stack[-1][1], " ", block, False))
                continue
            if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag in RAW:
                block += tag == "hr"
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if tag not in INLINE:
                block += 1
                closed, within = _CLOSES.get(tag, ({"p"}, {"table", "td", "li", "div", "section", "article", "main", "blockquote", "body"}))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        del stack[k:]
                        break
                    if stack[k][0] in within:
                        break
            label, out, doubt, maybe, main = _label(tag, m[3])
            _, path, above, children, link = stack[-1]
            out |= doubt and "*" not in path
            maybe = (maybe or doubt) and not out
            out |= tag == "header" and "*" not in path  # an article's own header holds its title
            label = f"{'*' if main else ''}{'~' if maybe else ''}{label}"
            here, inner = f"{path}/{label}", []
            if len(stack) > DEEPEST:
                here, inner = path, children
            elif not (out or above):
                children.append([label, "1", inner])
            stack.append((tag, here, out or above, inner, link or tag == "a"))
        text(size)


def fold(items: list) -> list:
    """Items with neighbouring repeats of one, two or three labels turned into repeated items."""
    done: list = []
    for item in items:
        item = [item[0], item[1], fold(item[2])]
        if done and done[-1][0] == item[0]:
            done[-1] = merge(done[-1], item, again=True)
        else:
            done.append(item)
    for period in (2, 3):
        i = 0
        while i + 2 * period <= len(done):
            names = [x[0] for x in done[i : i + 2 * period]]
            if names[:period] == names[period:]:
                group = [merge(a, b) for a, b in zip(done[i : i + period], done[i + period : i + 2 * period], strict=True)]
                j = i + 2 * period
                while [x[0] for x in done[j : j + period]] == names[:period]:
                    group = [merge(a, b) for a, b in zip(group, done[j : j + period], strict=True)]
                    j += period
                done[i:j] = [["(" + " ".join(names[:period]) + ")", "+", group]]
            i += 1
    return done


def _both(p: str, q: str, again: bool = False) -> str:
    many, none = again or p in "+*" or q in "+*", p in "?*" or q in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def merge(a: list, b: list, again: bool = False) -> list:
    """Two items of one label as one; ``again`` if they follow each other."""
    return [a[0], _both(a[1], b[1], again), align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """Longest common subsequence of labels; what only one side has becomes optional."""
    if not a and not b:
        return []
    pairs = matched([x[0] for x in a], [x[0] for x in b])
    out, i, j = [], 0, 0
    lone = lambda x: [x[0], _both(x[1], "?"), x[2]]
    for p, q in [*pairs, (len(a), len(b))]:
        out += [lone(x) for x in a[i:p]] + [lone(x) for x in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels in rising order: a longest common subsequence; of runs whose table would pass TABLE, one anchored at labels that both have once."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(x), len(y)
    if n * m > TABLE:
        inner = _anchored(x, y)
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        inner, i, j = [], 0, 0
        while i < n and j < m:
            if x[i] == y[j]:
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return ends[0] + [(i + head, j + head) for i, j in inner] + ends[1]


def _anchored(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Longest rising run of labels that both sides have once; what lies between two anchors is aligned by itself."""
    count, other = Counter(x), Counter(y)
    at = {label: j for j, label in enumerate(y) if other[label] == 1}
    once = [(i, at[label]) for i, label in enumerate(x) if count[label] == 1 and label in at]
    last, back, tops = [], [], []
    for k, (_, j) in enumerate(once):
        to = bisect_left(tops, j)
        tops[to : to + 1], last[to : to + 1] = [j], [k]
        back.append(last[to - 1] if to else -1)
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(once[k])
        k = back[k]
    out, i, j = [], 0, 0
    for p, q in [*reversed(run), (len(x), len(y))]:
        if (p - i) * (q - j) <= TABLE:
            out += [(i + u, j + v) for u, v in matched(x[i:p], y[j:q])]
        if p < len(x):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def mandatory(items: list) -> set[str]:
    """Paths of items that the expression has once on every page."""
    found, waiting = set(), [("", items)]
    while waiting:
        path, inside = waiting.pop()
        for label, times, inner in inside:
            if times == "1" and label[:1] != "(":
                here = path if label == "#" else f"{path}/{label}"
                if label == "#":
                    found.add(path)
                waiting.append((here, inner))
    return found


def expression(items: list) -> str:
    """A wrapper as a union-free regular expression over tags."""
    return " ".join(("" if x[0][:1] == "(" else x[0]) + (f"({expression(x[2])})" if x[2] else "") + (x[1] if x[1] != "1" else "") for x in items)


class Wrapper:
    """A host's aligned items, and of each slot: pages, characters, link characters, the text if it never varied."""

    def __init__(self, items: list | None = None, slots: dict | None = None, pages: int = 0):
        self.items, self.slots, self.pages, self.shapes = items, slots or {}, pages, set()

    def add(self, page: Page) -> None:
        items = fold(page.root[2])
        shape = hash_text(json.dumps(items))
        if shape not in self.shapes:
            if len(self.shapes) > 10_000:  # a shape that comes again is aligned again, which changes nothing
                self.shapes.clear()
            self.shapes.add(shape)
            self.items = items if self.items is None else align(self.items, items)
        own: dict[str, list] = {}
        for path, piece, _, link in page.texts:
            if (n := len(piece.strip())) > 0:
                slot = own.setdefault(path, [1, 0, 0, ""])
                slot[1] += n
                slot[2] += n * link
                slot[3] += piece
        for slot in own.values():
            slot[3] = hash_text(slot[3])
        self._join(own, 1)

    def _join(self, slots: dict, pages: int) -> None:
        self.pages += pages
        for path, (n, chars, links, fixed) in slots.items():
            if (mine := self.slots.get(path)) is None:
                self.slots[path] = [n, chars, links, fixed]
            else:
                mine[0], mine[1], mine[2] = mine[0] + n, mine[1] + chars, mine[2] + links
                mine[3] = fixed if fixed == mine[3] else None

    def join(self, other: Wrapper) -> None:
        if other.items is not None:
            self.items = other.items if self.items is None else align(self.items, other.items)
        self._join(other.slots, other.pages)

    def dump(self) -> str:
        return json.dumps([self.items, self.slots, self.pages])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))

    def template(self) -> list[str]:
        """Paths of slots that are not the article's: constant and on every page once; or in an element named like furniture, and mostly links or in one without varying text.

        Copies of one article leave most of its text constant, so constant text counts as
        the template's only where the text that varies inside the article outweighs it.
        """
        always = mandatory(self.items or [])
        prefix, named = self.article(), lambda path: "/~" in path or "/*~" in path
        alive = {container(p) for p, (_, chars, links, text) in self.slots.items() if named(p) and text is None and chars > links}
        fixed = [p for p, (n, _, _, text) in self.slots.items() if n >= FIXED_PAGES and text is not None and (container(p) not in alive if named(p) else p in always and n == self.pages)]
        held = sum(self.slots[p][1] for p in fixed if within(p, prefix))
        varied = sum(chars for p, (_, chars, _, text) in self.slots.items() if text is None and within(p, prefix))
        out = set(fixed) if self.pages >= FIXED_PAGES and varied > held else set()
        return sorted(out | {p for p, (_, chars, links, _) in self.slots.items() if named(p) and links > LINKED * chars})

    def article(self) -> str:
        """The path prefix that holds the article."""
        marked: dict[str, int] = {}
        for path, (_, chars, links, _) in self.slots.items():
            parts = path.split("/")
            if any(p.startswith("~") for p in parts):
                continue
            for tag in ("*article", "*"):
                k = next((k for k, p in enumerate(parts) if p.startswith(tag)), None)
                if k is not None:
                    key = "/".join(parts[: k + 1])
                    marked[key] = marked.get(key, 0) + chars - links
                    break
        if marked:
            return max(marked.items(), key=lambda x: (x[1], x[0]))[0]
        held: dict[str, int] = {}
        varied = {p: c - k for p, (_, c, k, fixed) in self.slots.items() if fixed is None} or {p: c - k for p, (_, c, k, _) in self.slots.items()}
        for path, chars in varied.items():
            parts = path.split("/")
            for k in range(1, len(parts) + 1):
                key = "/".join(parts[:k])
                held[key] = held.get(key, 0) + chars
        total = sum(varied.values())
        inside = [p for p, n in held.items() if n >= 0.8 * total and not p.rsplit("/", 1)[-1].split(".")[0] in INLINE | {"p", "h1", "h2", "h3", "li", "td"}]
        return max(inside, key=lambda p: (p.count("/"), p), default="")


def hash_text(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def container(path: str) -> str:
    """The path up to the first element that is named like furniture."""
    parts = path.split("/")
    k = next((k for k, p in enumerate(parts) if p[:1] == "~" or p[:2] == "*~"), len(parts))
    return "/".join(parts[: k + 1])


def within(path: str, prefix: str) -> bool:
    return path == prefix or path.startswith(prefix + "/") or not prefix


def main_text(page: Page, prefix: str, template: list[str] | None = None) -> str:
    """The page's blocks inside ``prefix`` but for the template's, in order; a page without any goes by its own wrapper."""
    left_out = set(template or ())
    chosen = [x for x in page.texts if within(x[0], prefix) and x[0] not in left_out]
    if not any(not x[1].isspace() for x in chosen):
        alone = Wrapper()
        alone.add(page)
        prefix, left_out = alone.article(), set(alone.template())
        chosen = [x for x in page.texts if within(x[0], prefix) and x[0] not in left_out]
    blocks: list[list[str]] = []
    last = None
    for _, piece, block, _ in chosen:
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(piece)
    return "\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


_WRAPPED = T.StructType([T.StructField("host", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("wrapper", T.StringType())])
#: Hosts a task folds at the same time before it hands their wrappers on.
HELD_HOSTS = 5_000
SALTS = 32


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS
    held: dict[str, Wrapper] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([w.dump() for w in held.values()], pa.string())], _WRAPPED.names)

    for batch in batches:
        for host, source in zip(batch.column(0), batch.column(1), strict=True):
            if (text := source.as_py()) is not None:
                held.setdefault(host.as_py(), Wrapper()).add(Page(text))
        if len(held) > HELD_HOSTS:
            yield rows()
            held.clear()
    yield rows()


def _merge_wrappers(table: pa.Table) -> pa.Table:
    whole = Wrapper()
    for text in sorted(table.column("wrapper").to_pylist()):
        whole.join(Wrapper.load(text))
    return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "salt": pa.array([0], pa.int32()), "wrapper": pa.array([whole.dump()], pa.string())})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of all pages (host, html)."""
    parts = pages.select("host", "html").mapInArrow(_fold_pages, _WRAPPED)
    return parts.groupBy("host", "salt").applyInArrow(_merge_wrappers, _WRAPPED).groupBy("host").applyInArrow(_merge_wrappers, _WRAPPED).select("host", "wrapper")


_DESCRIBED = T.StructType([T.StructField("article", T.StringType()), T.StructField("template", T.ArrayType(T.StringType())), T.StructField("expression", T.StringType()), T.StructField("pages", T.LongType())])


@F.arrow_udf(_DESCRIBED)
def described(wrapper: pa.Array) -> pa.Array:
    made = [Wrapper.load(w.as_py()) for w in wrapper]
    columns = [pa.array([w.article() for w in made], pa.string()), pa.array([w.template() for w in made], pa.list_(pa.string())), pa.array([expression(w.items or []) for w in made], pa.string()), pa.array([w.pages for w in made], pa.int64())]
    return pa.StructArray.from_arrays(columns, _DESCRIBED.names)


@F.arrow_udf(T.StringType())
def article_text(source: pa.Array, prefix: pa.Array, template: pa.Array) -> pa.Array:
    return pa.array([main_text(Page(s.as_py()), p.as_py() or "", t.as_py()) if s.is_valid else "" for s, p, t in zip(source, prefix, template, strict=True)], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty html, or one without article text, gives an empty text. Rows with a
    null or odd url share the empty host. Elements may nest and pages run on without bound. Repeated rows are extracted alike. An empty
    table gives an empty result; other columns are ignored.
    """
    source = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = infer_wrappers(source).select("host", described("wrapper").alias("d"))
    found = write_scratch(wrappers.select("host", "d.*"), "wrappers")
    joined = source.join(found.select("host", "article", "template"), "host", "left")
    text = joined.select("page_id", "url", article_text("html", "article", "template").alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))

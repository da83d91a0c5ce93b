"""Operator 8, main text of web pages by inferred wrappers.

A page is read as its stream of tags and texts, nested by the tags: elements that break lines are nodes, named by tag
and classes, and the texts between them are leaves. Inside a page, equal neighbours and equal runs of neighbours (``h2 p h2
p``) become repeated groups. A wrapper is a union-free regular expression over such streams: one host's pages are
aligned one after another, in each element the k-th child of a name with the k-th one; nodes that one side lacks become
optional, texts that differ become slots, and texts that all pages share stay fixed. All pages of a host take part: each
task merges the wrappers of its pages, partial wrappers are merged by host and salt and then by host. The result is the same
in whatever order pages are merged, and it holds every place of every page.

The wrapper decides for all pages of its host at once which leaves are main text (``decide``):

* mass is the text in slots that stands in no link, by page. Landmarks (``article``, ``main`` and their roles) weigh three
  times; the main text lies in the landmarks with most mass, or else in the deepest container with most of the mass;
* in there, navigation, footers, sidebars and other landmarks, forms, groups that are mostly links, and fixed texts
  are left out: those that are the same on all pages that have them, of which three or more have different longest texts. Words in classes and ids only support this: a whole name of such words (``share-bar``)
  leaves out an element unless it holds the article; a name with other words in it (``related-work``) only if its text is fixed
  or mostly links.

A host with fewer than three pages has no wrapper; its pages are judged alone by the same rules, where all text counts as
slot text. So is a page whose wrapper leaves it empty.

Null or empty html gives the empty text; a null url has no host; broken markup is read as browsers do (open elements end
with their container); elements nested deeper than ``DEEP`` count as their ancestor at that depth. Long pages are
read whole; alignment is linear in their elements. Repeated rows and ids keep their rows. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, whole, written

#: HTML element names by role, and words in classes and ids of what isn't the article.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|textarea|button|title|xmp|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget widgets footer masthead topbar toolbar share sharing social related recommended recommendations trending comment comments disqus replies reply respond newsletter subscribe signup login signin popup modal overlay paywall search pagination pager skip".split()
)
#: Words that leave a name of the words above as it is.
NEUTRAL = frozenset("site main page post article entry blog content box block bar list section area wrap wrapper container inner outer slot unit link links button buttons icon icons top bottom left right primary secondary global group item items form panel block thread".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
HEADERS = frozenset("header heading".split())
CONTENT = frozenset("article main".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS, NUMBER = re.compile(r"[a-z]+"), re.compile(r"\d{3,}")
#: What ends an open element of the same kind at its start.
CLOSES = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
SCOPE = frozenset("ul ol dl table article section div body main blockquote nav header footer aside form".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

DEEP = 150
#: Pages for a wrapper, and pages with different longest texts for a fixed text: copies of a page prove nothing.
LEAST = 3
#: Elements that say nothing by their name, and labels of those that hold prose.
GENERIC, PROSE = frozenset("div section span td center font".split()), re.compile(r"(?:p|h[1-6]|pre|blockquote)\b")
#: Flags of a node.
INSIDE, LANDMARK, FORM, NAMED, HINTED, HEADER, COMMENT = (1 << k for k in range(7))


def events(html: str):
    """("open", name, attributes) / ("close", name) / ("text", text) / ("break",) of a page."""
    stack: list[str] = []
    for m in TOKEN.finditer(html):
        if (text := m["text"]) is not None:
            yield "text", entities.unescape(text), None
            continue
        if (cdata := m["cdata"]) is not None:
            yield "text", cdata, None
            continue
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in ("p", "br"):
                yield "break", None, None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == name:
                    for _ in range(len(stack) - k):
                        yield "close", stack.pop(), None
                    break
                if name in INLINE and stack[k] not in INLINE or name not in SCOPE and stack[k] in ("table", "article", "body") and name not in ("html", "body"):
                    break
            continue
        if name in VOID:
            if name in ("br", "hr"):
                yield "break", None, None
            continue
        ends = CLOSES.get(name, "p" if name in ENDS_P else "").split()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in ends:
                    for _ in range(len(stack) - k):
                        yield "close", stack.pop(), None
                    break
                if stack[k] in SCOPE:
                    break
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m["attrs"])} if m["attrs"] and not m["attrs"].isspace() else {}
        if m["attrs"].endswith("/") and name not in SCOPE and name not in INLINE and name not in ENDS_P:
            continue
        stack.append(name)
        yield "open", name, attrs
    while stack:
        yield "close", stack.pop(), None


@functools.lru_cache(maxsize=10_000)
def flags(name: str, classes: str, ident: str, role: str, prop: str) -> int:
    out = INSIDE * (name in CONTENT or role in CONTENT or prop == "articlebody") | LANDMARK * (name in ASIDE or role in ROLES) | FORM * (name in ("form", "fieldset") or role == "form") | HEADER * (name == "header")
    for token in [*classes.split(), *ident.split()]:
        words = set(WORDS.findall(token))
        if words & COMMENTS:
            out |= COMMENT
        if words & MARKS:
            out |= NAMED if words <= MARKS | NEUTRAL else HINTED
        elif words and words <= HEADERS | NEUTRAL and words & HEADERS:
            out |= HEADER
    return out & ~(NAMED | HINTED) if name in ("html", "body") else out & ~INSIDE if out & COMMENT else out


# --- streams: a node is {"l": label, "f": flags, "n": pages, "r": repeated, "g": repeated with others, "k": children}; a text is {"l": "#", "h": hash or
# --- None for a slot, "n": pages, "c": characters, "a": of these in links, "i": places in the page, "d": longest texts of its pages}


def stream(html: str) -> tuple[dict, list[str]]:
    """A page's nested stream with repeats folded, and its texts in page order."""
    root = {"l": "", "f": 0, "n": 1, "r": False, "k": []}
    path, depth, texts, parts = [root], [], [], []
    links = in_links = 0

    def flush():
        nonlocal in_links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path[-1]["k"].append({"l": "#", "h": hash_of(text), "n": 1, "r": False, "c": len(text), "a": min(in_links, len(text)), "i": [len(texts)]})
                texts.append(text)
            parts.clear()
            in_links = 0

    for kind, what, attrs in events(html):
        if kind == "text":
            parts.append(what)
            if links:
                in_links += len(what.strip())
        elif kind == "break":
            flush()
        elif kind == "open":
            links += what == "a"
            classes = attrs.get("class", "").lower()
            marks = flags(what, classes, attrs.get("id", "").lower(), attrs.get("role", "").lower(), attrs.get("itemprop", "").lower())
            node = (what not in INLINE or bool(marks & (NAMED | LANDMARK))) and len(path) <= DEEP
            if what not in INLINE or node:
                flush()
            depth.append((what not in INLINE or node, node))
            if node:
                label = what + "".join("." + NUMBER.sub("0", c) for c in sorted(set(classes.split())))
                path.append({"l": label, "f": marks, "n": 1, "r": False, "k": []})
        else:
            links -= what == "a"
            breaks, node = depth.pop()
            if breaks:
                flush()
            if node:
                done = path.pop()
                done["k"] = fold(done["k"])
                if done["k"]:  # elements without text say nothing
                    if what in GENERIC:  # neighbours without a telling name are told apart by what they hold
                        done["l"] += "~" + ("t" if all(x["l"] == "#" for x in done["k"]) else "p" if any(PROSE.match(x["l"]) for x in done["k"]) else "b")
                    path[-1]["k"].append(done)
    flush()
    root["k"] = fold(root["k"])
    return root, texts


def hash_of(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def keyed(kids: list[dict]) -> list[tuple[str, int]]:
    """(label, how many of that label stand before) of each child: what aligns it with those of other pages."""
    seen: collections.Counter = collections.Counter()
    out = []
    for x in kids:
        out.append((x["l"], seen[x["l"]]))
        seen[x["l"]] += 1
    return out


def union(a: dict, b: dict, same_page: bool) -> dict:
    """One node or text for two of one label, of one page (a repeat) or of different pages.

    It doesn't matter in which order or grouping pages are united, but for the order of children with different labels.
    """
    n = max(a["n"], b["n"]) if same_page else a["n"] + b["n"]
    out = {"l": a["l"], "n": n, "r": same_page or a["r"] or b["r"]}
    if "g" in a or "g" in b:
        out["g"] = True
    if a["l"] == "#":
        out |= {"h": a["h"] if a["h"] == b["h"] else None, "c": a["c"] + b["c"], "a": a["a"] + b["a"]}
        if "i" in a:
            out["i"] = a["i"] + b["i"]
        if "d" in a:
            out["d"] = sorted({*a["d"], *b["d"]})[:LEAST]
        return out
    return out | {"f": a["f"] | b["f"], "k": align(a["k"], b["k"], same_page)}


def align(a: list[dict], b: list[dict], same_page: bool = False) -> list[dict]:
    """Two child lists as one: the k-th child of a label is united with the k-th one of the other side; what one side lacks is
    optional (seen on fewer pages)."""
    out = dict(zip(keyed(a), a, strict=True))
    for key, x in zip(keyed(b), b, strict=True):
        out[key] = union(out[key], x, same_page) if key in out else x
    return list(out.values())


def fold(kids: list[dict]) -> list[dict]:
    """Runs of one label, then runs of equal groups of labels, as repeated ones."""
    runs: list[dict] = []
    for x in kids:
        if runs and runs[-1]["l"] == x["l"]:
            runs[-1] = union(runs[-1], x, True)
        else:
            runs.append(x)
    labels = [x["l"] for x in runs]
    if len(set(labels)) == len(labels):
        return runs
    following, last = [0] * len(labels), {}
    for k in range(len(labels) - 1, -1, -1):
        following[k] = last.get(labels[k], 0) - k
        last[labels[k]] = k
    out, k = [], 0
    while k < len(runs):
        size, end = following[k], k
        if size > 1:
            group = labels[k : k + size]
            end = k + size
            while labels[end : end + size] == group:
                end += size
        if end > k + size > k:
            one = runs[k : k + size]
            for at in range(k + size, end, size):
                one = [union(a, b, True) for a, b in zip(one, runs[at : at + size], strict=True)]
            # the group's members stand for all its repeats, so they align with a page that has them once
            out += [{**x, "g": True} for x in one]
            k = end
        else:
            out.append(runs[k])
            k += 1
    return out


def bare(node: dict, longest: str) -> dict:
    """Without places in a page; each text with the page's longest text as its witness."""
    if node["l"] == "#":
        return {k: v for k, v in node.items() if k != "i"} | {"d": [longest]}
    return {**node, "k": [bare(x, longest) for x in node["k"]]}


def page(html: str) -> dict:
    found, texts = stream(html)
    return bare(found, hash_of(max(texts, key=len, default=""))[:8])


def shape(node: dict) -> str:
    return "#" if node["l"] == "#" else f"{node['l']}[{' '.join(map(shape, node['k']))}]"


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages."""
    return functools.reduce(lambda a, b: union(a, b, False), [page(p) for p in pages])


# --- decisions ----------------------------------------------------------------------------------------------

MOSTLY = 0.6


def measure(node: dict, pages: int, inside: bool = False) -> dict:
    """A copy with, for each node, mass (slot text outside links a page), all text, text in links, fixed text."""
    if node["l"] == "#":
        fixed = node["h"] is not None and len(node["d"]) >= LEAST
        chars, links = node["c"] / pages, node["a"] / pages
        return {**node, "mass": 0.0 if fixed else chars - links, "all": chars, "links": links, "fixed": chars if fixed else 0.0}
    # by label, so that sums don't depend on the order in which pages were united
    kids = [measure(x, pages, inside or bool(node["f"] & INSIDE)) for x in sorted(node["k"], key=lambda x: x["l"])]
    out = {**node, "k": kids} | {c: sum(x[c] for x in kids) for c in ("mass", "all", "links", "fixed")}
    if out["f"] & HEADER and not inside and not out["f"] & INSIDE:
        out["f"] |= LANDMARK
    return out


def walk(node: dict):
    yield node
    for x in node.get("k", ()):
        yield from walk(x)


def landmarks(node: dict, aside: bool = False) -> list[tuple[dict, bool]]:
    """(outermost article or main, whether it lies in something left out)."""
    if node["l"] == "#":
        return []
    if node["f"] & INSIDE:
        return [(node, aside)]
    return [x for k in node["k"] for x in landmarks(k, aside or bool(node["f"] & (LANDMARK | NAMED | COMMENT)))]


def narrowed(node: dict) -> list[dict]:
    """The articles inside a landmark, if they hold most of it."""
    inner = [x for k in node["k"] for x, aside in landmarks(k) if not aside]
    if inner and sum(x["mass"] for x in inner) >= MOSTLY * node["mass"]:
        return [y for x in inner for y in narrowed(x)]
    return [node]


def elsewhere(node: dict, marked: set[int]) -> tuple[float, bool]:
    """Mass outside the marked nodes and outside what flags leave out, and whether the node holds a marked one."""
    if id(node) in marked:
        return 0.0, True
    if node["l"] == "#":
        return node["mass"], False
    found = [elsewhere(x, marked) for x in node["k"]]
    holds = any(h for _, h in found)
    return (sum(m for m, _ in found) if holds or not node["f"] & (LANDMARK | NAMED | COMMENT) else 0.0), holds


def containers(root: dict) -> list[dict]:
    """Where the main text lies."""
    marked = landmarks(root)
    marked = [x for x, aside in marked if not aside] or [x for x, _ in marked]
    top = max((x["mass"] for x in marked), default=0.0)
    marked = [x for x in marked if not (x["mass"] < 0.1 * top and x["links"] > 0.5 * x["all"])]
    if marked and 3 * sum(x["mass"] for x in marked) >= elsewhere(root, {id(x) for x in marked})[0]:
        return [y for x in marked for y in narrowed(x)]
    now = root
    while True:
        usable = [x for x in now["k"] if x["l"] != "#" and not left_out(x, root["mass"])]
        mass = sum(x["mass"] for x in usable) + sum(x["mass"] for x in now["k"] if x["l"] == "#")
        best = max(usable, key=lambda x: x["mass"], default=None)
        if best is None or best["mass"] < MOSTLY * mass or all(x["l"] == "#" for x in best["k"]) or "g" in best:
            return [now]
        if any(x["l"][:2] in ("h1", "h2") and x["mass"] > 0 for x in usable):
            return [now]  # a headline beside its text
        now = best


def left_out(node: dict, total: float) -> bool:
    """Whether a node isn't article text; ``total`` is the mass of what it is judged within."""
    if node["l"] == "#":
        return node["fixed"] > 0
    share = node["mass"] / total if total > 0 else 1.0
    holds = any(x["f"] & INSIDE and x["mass"] >= 0.5 * total for x in walk(node) if x["l"] != "#")
    if node["f"] & LANDMARK:
        return not holds
    if node["f"] & COMMENT:
        return not holds
    if node["f"] & NAMED:
        return not holds and share < 0.9
    if node["f"] & FORM:
        return not holds and share < 0.5
    mostly_links = node["all"] > 0 and node["links"] > 0.7 * node["all"]
    if node["f"] & HINTED:
        return share < 0.5 and (mostly_links or node["links"] > 0.4 * node["all"] or node["fixed"] >= node["all"])
    return mostly_links and re.split(r"[.~]", node["l"])[0] in ("ul", "ol", "div", "section", "table", "dl") and share < 0.5


def decide(wrapper: dict) -> dict:
    """The wrapper with "m" true on the texts that are main text."""
    root = measure(wrapper, max(wrapper["n"], 1))
    chosen = containers(root)
    total = sum(x["mass"] for x in chosen)

    def mark(node: dict, inside: bool) -> None:
        own = any(node is x for x in chosen)
        if inside and not own and left_out(node, total) and (total > 0 or node["l"] != "#"):
            return
        if node["l"] == "#":
            node["m"] = inside
        for x in node.get("k", ()):
            mark(x, inside or own)

    mark(root, False)
    return slim(root)


def slim(node: dict) -> dict:
    if node["l"] == "#":
        return {"l": "#", "m": node.get("m", False)}
    return {"l": node["l"], "k": [slim(x) for x in node["k"]]}


def chosen_places(page: dict, wrapper: dict, out: list[tuple[int, bool]]) -> None:
    """(place, main text or not) of the page's texts by the wrapper, which holds all that the page holds."""
    there = dict(zip(keyed(wrapper["k"]), wrapper["k"], strict=True))
    for key, x in zip(keyed(page["k"]), page["k"], strict=True):
        if x["l"] == "#":
            out += [(i, there[key]["m"]) for i in x["i"]]
        else:
            chosen_places(x, there[key], out)


def leaves(node: dict) -> list[list[int]]:
    return [node["i"]] if node["l"] == "#" else [x for k in node["k"] for x in leaves(k)]


class Extractor:
    """Main text of pages; decisions are kept by wrapper and shape of a page, up to a bound."""

    MOST = 20_000

    def __init__(self):
        self.known: dict = {}
        self.opened = functools.lru_cache(maxsize=200)(json.loads)

    def decision(self, page: dict, wrapper: str | None) -> list[bool]:
        """For each leaf of the page whether it is main text."""
        found: list[tuple[int, bool]] = []
        if wrapper:
            chosen_places(page, self.opened(wrapper), found)
        else:
            chosen_places(page, decide(bare(page, "")), found)
        main = dict(found)
        return [main.get(places[0], False) for places in leaves(page)]

    def text(self, html: str, wrapper: str | None) -> str:
        page, texts = stream(html)
        keep: list[int] = []
        for own in dict.fromkeys((wrapper, None)):
            if own:  # a page judged alone is judged by its texts too, so only a wrapper's decisions are kept
                key = (hash(own), shape(page))
                if key not in self.known:
                    if len(self.known) >= self.MOST:
                        self.known.clear()
                    self.known[key] = self.decision(page, own)
                flags_ = self.known[key]
            else:
                flags_ = self.decision(page, None)
            keep = sorted(i for places, main in zip(leaves(page), flags_, strict=True) if main for i in places)
            if keep:
                break
        return " ".join(texts[i] for i in keep)


def main_text(html: str, wrapper: str | None = None) -> str:
    return Extractor().text(html, wrapper)


# --- on Spark -----------------------------------------------------------------------------------------------

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
#: Wrappers that are sent to all tasks: at most so many hosts and so many bytes, else they are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 32_000_000
#: Partial wrappers of a host are merged in so many groups first; a task holds the wrappers of so many characters at once.
SALTS, HELD = 256, 200_000_000


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for each host with at least three pages: what its pages' texts are by place."""

    def partial(batches):
        task, held, size = TaskContext.get().partitionId(), {}, 0

        def flush():
            rows = [(host, task % SALTS, json.dumps(one)) for host, one in held.items()]
            return pd.DataFrame(rows, columns=["host", "salt", "wrapper"])

        for pdf in batches:
            for host, html in zip(pdf["host"], pdf["html"], strict=True):
                one = page(html)
                held[host] = union(held[host], one, False) if host in held else one
                size += len(html)
            if size > HELD:
                yield flush()
                held, size = {}, 0
        yield flush()

    def merged(pdf: pd.DataFrame) -> dict:
        return functools.reduce(lambda a, b: union(a, b, False), map(json.loads, pdf["wrapper"]))

    def by_salt(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "wrapper": [json.dumps(merged(pdf))]})

    def by_host(pdf: pd.DataFrame) -> pd.DataFrame:
        one = merged(pdf)
        rows = [(pdf["host"].iat[0], json.dumps(decide(one)))] if one["n"] >= LEAST else []
        return pd.DataFrame(rows, columns=["host", "wrapper"])

    hosted = pages.select(host_of("url").alias("host"), whole("html").alias("html")).filter("host <> ''")
    parts = hosted.mapInPandas(partial, "host string, salt int, wrapper string")
    return parts.groupBy("host", "salt").applyInPandas(by_salt, "host string, wrapper string").groupBy("host").applyInPandas(by_host, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = written(wrappers(own), "wrappers")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()
    small = n <= BROADCAST_HOSTS and size <= BROADCAST_BYTES

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        one = Extractor()
        for html, wrapper in batches:
            yield pd.Series([one.text(h, w) for h, w in zip(html, wrapper, strict=True)], dtype=object)

    rows = own.withColumn("host", host_of("url"))
    rows = rows.join(F.broadcast(found) if small else found.hint("merge"), "host", "left")
    return rows.select("page_id", "url", text(whole("html"), F.col("wrapper")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

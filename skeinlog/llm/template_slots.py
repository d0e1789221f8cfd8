"""Operator 8: main text of pages by equivalence-class template deduction.

Pages of one host come from few templates.  A page is read as tokens: opening
and closing tags with the names they stand under (boxes also by their class and id
as a whole, which sets apart boxes of different roles), and text nodes.
Tokens of a host that occur equally often in every page share an occurrence
vector and form an equivalence class.  The vector is never collected: a token
carries how many pages hold it and the sums of two halves of a hash of (page,
count), so that repeated pages add up and never cancel out.  Classes that are
frequent (half of the host's pages or more, three at least) and large (two tokens or
more) are valid; the class that most pages share is the template's skeleton and the
others nest into its slots.

What the template holds is furniture, what varies stands in slots:

* the innermost box that the template has once a page and that carries half of the
  host's varying text or more is the main slot;
* if there is none, all slots count but those of boxes that carry under a tenth;
* text that the template holds is furniture in any slot, unless it makes up half of
  its article or more: then pages copy each other's article;
* a first-rank heading that varies belongs to the text wherever it stands.

Tags and ARIA roles are a check on the slots: menus, page headers, footers, sidebars,
forms, scripts and styles never count, nor do articles within articles (reader
comments by the standard); a slot within an article is widened to it; an article wins
where the main slot lies beside it.  Names of classes and ids decide nothing, but for
an element called ``comments`` and nothing else: readers' comments vary like the
article they stand in.  Hosts with fewer than three pages have no template; their
marked articles, or all text if there are none, are read by roles alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import cuts

MIN_PAGES = 3
#: Template tokens up to this many are sent to every worker (8 bytes each); more are joined by shuffle.
BROADCAST_TOKENS = 1_000_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?![^\s=>/])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_CLOSES |= {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_FENCES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
_ASIDE = frozenset("nav footer aside form script style noscript template iframe head title select button textarea dialog menu object svg canvas".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Elements that may be a slot's box; those in the second set are told apart by class and id.
_BOXES = frozenset("article main section div td center".split())
_NAMED = frozenset("section div td center".split())
TAG, BOX, TEXT, PAGE = range(4)


@dataclass(frozen=True)
class Template:
    """What a host's template says: its main slot's box (0: none), boxes of slight slots, and its texts."""

    main: int = 0
    boxes: frozenset = frozenset()
    texts: frozenset = frozenset()


def _token(*parts: str) -> int:
    value = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _text_token(path: int, text: str) -> int:
    return _token(str(path), "#text", text)


def _role(name: str, attributes: str, inside: int) -> tuple[bool, str]:
    """Whether an element's tag or ARIA role takes it out of the main text, and its class and id."""
    apart = name in _ASIDE or (name == "header" and not inside) or (name == "article" and inside == 2)
    called = ""
    if attributes and not attributes.isspace():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).strip().lower()
            if key in ("class", "id"):
                called += f"\x01{key}={value}"
                apart = apart or value == "comments"
            elif key == "role":
                apart = apart or value in _ASIDE_ROLES
            else:
                apart = apart or key == "hidden" or value == "true"
    return apart, called


def read_page(page: str) -> Iterator[tuple]:
    """Events of a page in order.

    ("open", name, node, path, parent, apart, inside) and ("shut", name, node,
    parent, said) in pairs that nest, ("text", raw, path, apart), and ("break",
    name) for a stray end tag.  ``path`` names the element by the tags it stands
    under, ``node`` also by its class and id if it is a box; ``apart`` tells that
    it is no main text by its role, ``inside`` whether it stands in a main (1) or
    article element (2), ``said`` whether the page has the end tag.
    """
    stack: list[tuple] = [("", 0, 0, False, 0)]  # name, node, path, apart, inside
    open_: Counter = Counter()
    at, end = 0, len(page)

    def shut(depth: int, said: bool):
        while len(stack) > depth:
            name, node, _, _, _ = stack.pop()
            open_[name] -= 1
            yield ("shut", name, node, stack[-1][2], said and len(stack) == depth)

    while at < end:
        found = _TAG.search(page, at)
        start = found.start() if found else end
        if start > at:
            yield ("text", page[at:start], stack[-1][2], stack[-1][3])
        if not found:
            break
        at = found.end() if found.end() > found.start() else found.start() + 1
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if open_[name] > 0:
                yield from shut(max(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name) if stack[-1][0] != name else len(stack) - 1, True)
            elif name in _BLOCK:
                yield ("break", name)
            continue
        closes = _CLOSES.get(name)
        if closes and any(open_[c] > 0 for c in closes):
            fences = _FENCES.get(name, ())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closes:
                    yield from shut(depth, False)
                    break
                if stack[depth][0] in fences or stack[depth][0] in ("article", "main", "section", "div", "td", "th", "body") and name != "tr":
                    break
        _, _, parent, aside, inside = stack[-1]
        out, called = _role(name, found[3], inside)
        path = _token(str(parent), name)
        node = _token(str(parent), name, called) if called and name in _NAMED else path
        apart = aside or out
        inside = 2 if name == "article" else max(inside, 1) if name == "main" else inside
        yield ("open", name, node, path, parent, apart, inside)
        if name in _RAW:
            close = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else end
            yield ("shut", name, node, parent, False)
        elif name in _VOID or found[3].rstrip().endswith("/"):
            yield ("shut", name, node, parent, False)
        else:
            stack.append((name, node, path, apart, inside))
            open_[name] += 1
    yield from shut(1, False)


def page_tokens(page: str) -> list[tuple[int, int, int, int, int, int, int]]:
    """(token, how often, first place, path, parent, kind, characters) of a page's tokens.

    Characters are those of main text by role: of a text node, or below a box;
    token 0 stands for the page.  Texts that are out by their role aren't listed.
    """
    count: Counter = Counter()
    first: dict = {0: (0, 0, 0, PAGE)}
    chars: Counter = Counter()
    begun: list[int] = []
    total = 0
    for place, event in enumerate(read_page(page)):
        if event[0] == "open":
            _, name, token, path, parent, apart, _ = event
            begun.append(total)
            first.setdefault(token, (place, path, parent, BOX if name in _BOXES and not apart else TAG))
        elif event[0] == "shut":
            _, _, node, parent, said = event
            chars[node] += total - begun.pop()
            if not said:
                continue
            token = ~node
            first.setdefault(token, (place, token, parent, TAG))
        elif event[0] == "text" and not event[3]:
            text = " ".join(event[1].split())
            if not text:
                continue
            token = _text_token(event[2], text)
            total += len(text)
            chars[token] += len(text)
            first.setdefault(token, (place, token, event[2], TEXT))
        else:
            continue
        count[token] += 1
    count[0], chars[0] = 1, total
    return [(t, n, *first[t], chars[t] if first[t][3] else 0) for t, n in count.items()]


def host_of(column):
    """Host of a URL in lower case; an URL without one stands for itself."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")), column, F.lit("")))


_COUNTED = ["token", "n", "pos", "path", "parent", "kind", "chars"]
#: Bytes of pages that are read at a time; a longer page makes a step of its own.
STEP_BYTES = 2 << 20


def token_counts_by_page(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``host``, ``page`` and the columns of ``page_tokens`` for every page."""
    kept = pages.select(host_of(F.col(f"`{url}`").cast("string")).alias("host"), F.xxhash64(F.col(f"`{page_id}`"), F.col(f"`{url}`"), F.col(f"`{html}`")).alias("page"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column(2), STEP_BYTES):
                part = batch.slice(a, b - a)
                rows = [(host, page, *t) for host, page, text in zip(*[c.to_pylist() for c in part.columns], strict=True) for t in page_tokens(text or "")]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["host", "page", *_COUNTED])

    return kept.mapInArrow(run, "host string, page long, " + ", ".join(f"{c} long" for c in _COUNTED))


def classes(counted: DataFrame, sizes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``n_pages``, ``support``, ``total``, ``members``: valid equivalence classes, members in page order.

    ``sizes``: ``host, n_pages`` of the hosts that have a template.
    """
    seen = F.xxhash64("page", "n")
    vectors = counted.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.sum(seen.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(seen, 32)).alias("high"), F.sum("n").alias("total"), F.avg("pos").alias("pos"),
        F.min("path").alias("path"), F.min("parent").alias("parent"), F.max("kind").alias("kind"), F.sum("chars").alias("chars"),
    )
    frequent = vectors.where(f"support >= {min_pages}").join(sizes, "host").where("2 * support >= n_pages")
    grouped = frequent.groupBy("host", "n_pages", "support", "low", "high", "total").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "path", "parent", "kind", "chars"))).alias("members"))
    return grouped.where(F.size("members") >= 2).drop("low", "high")


def nested(found: list[dict]) -> list[int]:
    """Tokens of a host's template in page order.

    The class that the most pages share, and among those the largest, is the
    skeleton; a further class is taken if the parent of each member is a member
    of the template built so far or of itself, so that it nests in one of its slots.
    """
    ordered = sorted(found, key=lambda c: (-c["support"], -len(c["members"]), c["members"][0]["pos"], c["members"][0]["token"]))
    if not ordered:
        return []
    path_of = lambda m: m.get("path", m["token"])
    kept = {m["token"]: m["pos"] for m in ordered[0]["members"]}
    paths = {0, *map(path_of, ordered[0]["members"])}
    waiting = ordered[1:]
    while True:
        rest = []
        for c in waiting:
            own = set(map(path_of, c["members"]))
            if all(m["parent"] in paths or m["parent"] in own for m in c["members"]):
                kept.update((m["token"], m["pos"]) for m in c["members"])
                paths |= own
            else:
                rest.append(c)
        if len(rest) == len(waiting):
            return [t for t, _ in sorted(kept.items(), key=lambda x: (x[1], x[0]))]
        waiting = rest


def slots(found: list[dict]) -> tuple[int, list[int], list[int]]:
    """Main slot's box, boxes of slight slots and texts of the template that a host's classes make."""
    tokens = set(nested(found))
    members = [(m, c["total"] == c["support"]) for c in found for m in c["members"] if m["token"] in tokens]
    above = {m["path"]: m["parent"] for m, _ in members if m["kind"] in (TAG, BOX)}

    def way_up(path: int) -> list[int]:
        way = []
        while path and len(way) <= len(above):
            way.append(path)
            path = above.get(path, 0)
        return way

    fixed: dict = defaultdict(int)
    texts = [m for m, _ in members if m["kind"] == TEXT]
    for m in texts:
        for path in {0, *way_up(m["parent"])}:
            fixed[path] += m["chars"]
    varying = sum(m["chars"] for m, _ in members if m["kind"] == PAGE) - fixed[0]
    boxes = [(max(0, m["chars"] - fixed[m["path"]]), len(way_up(m["path"])), m["token"]) for m, once in members if m["kind"] == BOX and once]
    large = [b for b in boxes if varying > 0 and 2 * b[0] >= varying]
    main = max(large, key=lambda b: (b[1], b[0], b[2]))[2] if large else 0
    slight = sorted(t for held, _, t in boxes if 10 * held < varying) if not main else []
    return main, slight, sorted(m["token"] for m in texts)


def templates(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``main``, ``boxes``, ``texts`` of each host with enough pages (see ``Template``).

    A host's classes hold tokens that stand in half of its pages or more, so
    what comes together for a host is bounded by the size of a page.
    """
    host = host_of(F.col(f"`{url}`").cast("string"))
    sizes = pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    found = classes(token_counts_by_page(pages, page_id, url, html), sizes, min_pages)
    by_host = found.groupBy("host").agg(F.collect_list(F.struct("support", "total", "members")).alias("classes"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            made = [slots(c.as_py()) for c in batch.column(1)]
            main, boxes, texts = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(main, pa.int64()), pa.array(boxes, longs), pa.array(texts, longs)], names=["host", "main", "boxes", "texts"])

    return by_host.mapInArrow(build, "host string, main long, boxes array<bigint>, texts array<bigint>")


def main_text(page: str, template: Template = Template()) -> str:
    """Text of a page's main slots."""
    events = list(read_page(page))
    begun: list[int] = []
    articles, main, slight, heads = [], [], [], []
    for k, e in enumerate(events):
        if e[0] == "open":
            begun.append(k)
        elif e[0] == "shut":
            s = begun.pop()
            _, name, node, _, _, apart, _ = events[s]
            if apart:
                continue
            if name in ("article", "main"):
                articles.append((s, k))
            if node == template.main:
                main.append((s, k))
            if node in template.boxes:
                slight.append((s, k))
            if name == "h1":
                heads.append((s, k))
    outer: list[tuple] = []
    for a in sorted(articles):
        if not outer or a[0] > outer[-1][1]:
            outer.append(a)
    meets = lambda x, y: x[0] <= y[1] and y[0] <= x[1]
    if main and (not outer or any(meets(m, a) for m in main for a in outer)):
        region = [min([m, *[a for a in outer if a[0] <= m[0] and m[1] <= a[1]]]) for m in main]
        region += heads if template.texts or template.main else []
    else:
        region = outer
    counts = bytearray(len(events)) if region else bytearray(b"\x01") * len(events)
    for s, t in region:
        counts[s:t] = b"\x01" * (t - s)
    if not region:
        for s, t in slight:
            counts[s:t] = bytes(t - s)
        for s, t in heads:
            counts[s:t] = b"\x01" * (t - s)
    furniture: set[int] = set()
    if template.texts:
        spoken = [(k, " ".join(e[1].split())) for k, e in enumerate(events) if e[0] == "text" and counts[k] and not e[3]]
        furniture = {k for k, text in spoken if text and _text_token(events[k][2], text) in template.texts}
        # template text of half an article or more is the article of pages that copy each other
        if region and 2 * sum(len(t) for k, t in spoken if k in furniture) >= sum(len(t) for _, t in spoken):
            furniture = set()
    blocks: list[str] = []
    open_: list[str] = []
    for k, e in enumerate(events):
        if e[0] != "text":
            if e[1] in _BLOCK:
                blocks.append("".join(open_))
                open_ = []
        elif counts[k] and not e[3] and k not in furniture:
            open_.append(e[1])
    blocks.append("".join(open_))
    return " ".join(" ".join(words) for b in blocks if (words := entities.unescape(b).split()))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row.

    Null and empty pages give an empty text; a null URL is a host of its own
    name.  Repeated rows give repeated results (and count as a page each for
    the template); an empty table gives an empty one; other columns are not read.
    """
    from skeinlog.session import checkpointed

    made = checkpointed(templates(pages, page_id, url, html, min_pages))
    size = made.agg(F.sum(F.lit(4) + F.size("boxes") + F.size("texts"))).first()[0] or 0
    rows = pages.select(F.col(f"`{page_id}`").alias("__id"), F.col(f"`{url}`").alias("__url"), F.col(f"`{html}`").cast("string").alias("__html"), host_of(F.col(f"`{url}`").cast("string")).alias("host"))
    if size <= BROADCAST_TOKENS:
        sent = made.toArrow()
        held = pages.sparkSession.sparkContext.broadcast(sent)
        places = {host: i for i, host in enumerate(sent.column(0).to_pylist())}
        joined = rows
    else:
        held, places = None, {}
        joined = rows.join(made, "host", "left").select("__id", "__url", "__html", "host", "main", "boxes", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            hosts = batch.column(3).to_pylist()
            for a, b in cuts(batch.column(2), STEP_BYTES):
                texts = []
                for i, page in enumerate(batch.column(2).slice(a, b - a).to_pylist(), a):
                    host = hosts[i]
                    if host not in seen:
                        if len(seen) >= 256:
                            seen.clear()
                        source, at = (batch, i) if held is None else (held.value, places.get(host))
                        given = [source.column(c)[at].as_py() for c in ((4, 5, 6) if held is None else (1, 2, 3))] if at is not None else [None]
                        seen[host] = Template() if given[0] is None else Template(given[0], frozenset(given[1]), frozenset(given[2]))
                    texts.append(main_text(page or "", seen[host]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    schema = joined.select("__id", "__url").schema.add("text", "string").add("n_chars", "long")
    return joined.mapInArrow(run, schema).withColumnsRenamed({"__id": page_id, "__url": url})

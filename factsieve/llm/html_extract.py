"""Main text of web pages by host consensus.

Every page is read into blocks, each with the path of the containers around it. A path step is a
tag with its classes, digits left out, so that pages of one template agree. Blocks in menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments and hidden
parts are left out. Containers outside of articles whose own blocks are mostly links do not score,
and are left out below the winner too where the host repeats the links. A name alone
never decides on a page's whole text: main and article count within containers of such names,
and a container that holds four fifths of the text of the pages where a host has it counts too, as
does a form around the page. Names are compared by whole parts, and never leave out a heading or a
part of a sentence.

First pass: a page scores each of its containers by the share of the page's characters below
it, in thousandths, and these votes are added up per host and path. The winner of a host lies on
the way down along the paths with at least four fifths of the votes that are possible. The way
ends at the first article or main, and above a container beside which most pages have other
text, unless the host repeats that text from page to page. Into an article or main it goes on
unless that text stands in no container of its own.

Second pass: each page is read again and yields the blocks below its host's winning path. Where
these hold less than four fifths of the page's text, less what the host repeats beside that
path, the page's own path is taken, found in the same way.

Null, empty and textless pages give the empty text. Pages of any length and depth are read in linear
time. Pages without a host form one group. Of paths with equal votes at one depth the
first in order of text wins. Repeated rows give repeated rows, and an empty table none. Only page_id,
url and html are read, whatever other columns are named.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.batches import map_rows
from factsieve.llm.storage import checkpointed

#: Share of the votes, in thousandths, that a winning path needs.
WINNING = 800
#: Relative error of the counts of different texts, which are compared at a ratio of two.
ERROR = 0.1
#: Containers on a path; browsers stop nesting at some hundreds.
DEPTH = 128
#: Winners are broadcast up to this many characters of hosts and paths, else joined by a shuffle.
BROADCAST_CHARS = 8 << 20

# The elements that HTML has for each purpose.
CONTAINERS = frozenset("body main article section div center table tbody thead tfoot tr td th ul ol dl blockquote figure details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary header footer nav aside form fieldset menu".split())
WRAPPERS = CONTAINERS | frozenset("header footer nav aside form fieldset menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SKIPPED = frozenset("head title noscript template iframe object svg canvas nav aside footer menu select button textarea dialog".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "caption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# The author's choice of names, by whole parts of a class or id. Names of page parts mark a container
# whatever stands before them; other names only together with words of place and shape.
PARTS = frozenset(
    """nav navbar navigation menu masthead footer sidebar ads advert adverts advertisement advertisements advertising
    breadcrumb breadcrumbs pagination pager toolbar comments cookie cookies newsletter gdpr disqus""".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising promo sponsor sponsored newsletter cookie cookies".split())
NAMES = PARTS | ADVERTS | frozenset(
    """aside widget widgets banner banners promotion promotions promoted sponsors consent notice notices alert alerts popup
    modal subscribe signup login comment respond share sharing social related copyright disclaimer overlay""".split()
)
SHAPES = frozenset(
    """area articles bar block blocks body bottom box btn button buttons center col column container content desktop first
    fixed form frame global group holder home icon icons inline inner item items js large last left link links list main media
    mobile module news outer page panel post posts primary region right row section secondary side site slot small space
    sticky stories sub text this thread top unit wrap wrapper zone""".split()
)
#: Forms that tell what a container has, lacks or is filed under, not what it is.
MODIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without|category|tag)[_-]\S*")
TOP = re.compile(r"(?:^|[\s_-])header(?=$|[\s_\d-])")

# A quote opens a value only after an equals sign; an unquoted value ends at white space or at the end of the tag.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[-_\d]+")

_ARTICLE = re.compile(r"/(?:article|main)(?:\.[^/]*)?(?=/|$)")

Block = tuple[str, str, int]
#: Set before the step of a container that is left out for its name.
MARK = "!"


KEPT, NAMED, GONE = range(3)


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """The tag and its classes without digits."""
    names = _DIGITS.sub("", attributes.get("class", "")).lower().replace("/", "").replace(MARK, "").split()
    return ".".join([tag, *sorted(set(names))])


def _boilerplate(name: str, words: frozenset[str] = NAMES) -> bool:
    """Whether a class or id names boilerplate: ``ad-slot`` and ``site-footer`` do, ``ad-free`` does not."""
    parts = [p for p in _SPLIT.split(name) if p]
    if not parts or not any(p in words for p in parts):
        return False
    return parts[-1] in PARTS and words is NAMES or all(p in words or p in SHAPES for p in parts)


def _named(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether a block is left out for its name; headings never are, and text in an article only as an advert."""
    if tag in HEADINGS:
        return False
    names = MODIFIER.sub("", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    words = ADVERTS if inside and tag not in WRAPPERS else NAMES
    return any(_boilerplate(n, words) for n in names.split()) or (not inside and bool(TOP.search(names)))


def _left_out(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """Whether an element is no part of the main text, by itself or by its name only; ``inside`` an article a header may be."""
    if tag in SKIPPED or (tag == "header" and not inside):
        return GONE
    if tag == "form" and "hidden" not in attributes:
        return NAMED  # one around most of the page is a wrapper like any other
    if not attributes or tag in ("html", "body", "main", "article"):
        return KEPT
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return GONE
    if _NO_DISPLAY.search(attributes.get("style", "")):
        return GONE
    return NAMED if tag in BLOCKS and _named(tag, attributes, inside) else KEPT


def _resets(tag: str, attributes: dict[str, str], path: str) -> bool:
    """Whether an element is main text though a container around it has a name of boilerplate.

    A main is, and so is an article, unless it is a comment by its own name or the container lies within an article.
    """
    if tag == "article":
        before = path.partition("/" + MARK)[0]
        return not ("/article" in before or "/main" in before or _named(tag, attributes, True))
    return tag == "main"


def blocks(html: str | None) -> list[Block]:
    """(path, text, characters in links) of the blocks that may be main text, in page order.

    Steps left out by name are marked. Paths end after ``DEPTH`` steps; what lies deeper has the
    path of the container at that depth.
    """
    found: list[Block] = []
    opened: Counter = Counter()  # open elements by tag
    stack: list[tuple[str, str, int]] = [("", "", KEPT)]  # tag, path, whether its text is passed over
    pieces: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text, path = "".join(pieces), stack[-1][1]
            share = linked / len(text)
            text = " ".join((markup.unescape(text) if "&" in text else text).split())
            if text:
                found.append((path, text, round(share * len(text))))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for tag, _, _ in stack[depth:]:
            opened[tag] -= 1
            links -= tag == "a"
        if any(tag in BLOCKS for tag, _, _ in stack[depth:]):
            flush()
        del stack[depth:]

    def open_at(tags: frozenset | set, stop: frozenset | set) -> int:
        if not any(opened[tag] for tag in tags):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in stop:
                return 0
        return 0

    html, at = html or "", 0
    while token := _TOKEN.match(html, at):
        at = token.end()
        ending, tag, attributes = token.groups()
        if tag is None:
            text = token.group()
            if not text.startswith(("<!", "<?")) and not stack[-1][2]:
                pieces.append(text)
                linked += len(text) if links else 0
            continue
        tag = tag.lower()
        if ending:
            depth = open_at({tag}, {"article", "body"} - {tag} if tag in ("p", "li") else set())
            if depth:
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            pieces.append("\n")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCKS or tag == "body":
            if tag in ENDS_P and (depth := open_at({"p"}, CONTAINERS)):
                close(depth)
            if tag in CLOSED_BY and (depth := open_at(CLOSED_BY[tag], {"ul", "ol", "dl", "table", "body"})):
                close(depth)
            if tag == "body" and (depth := open_at({"head"}, set())):
                close(depth)
            flush()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        _, path, out = stack[-1]
        inside = "/article" in path or "/main" in path
        named = _attributes(attributes) if attributes else {}
        kind = _left_out(tag, named, inside)
        if (MARK in path or out == NAMED) and _resets(tag, named, path):
            path, out = path.replace("/" + MARK, "/"), out if out == GONE else KEPT
        if kind == NAMED and tag in BLOCKS:
            if path.count("/") < DEPTH:
                kind, path = KEPT, f"{path}/{MARK}{_step(tag, named)}"
        elif tag in CONTAINERS and path.count("/") < DEPTH:
            path = f"{path}/{_step(tag, named)}"
        stack.append((tag, path, max(out, kind)))
        opened[tag] += 1
        links += tag == "a"
    flush()
    return found


def mostly_links(found: list[Block]) -> dict[str, tuple[int, int]]:
    """The containers outside of articles whose own blocks, taken together, are mostly links: characters and a hash."""
    sums: dict[str, tuple[int, int, int]] = {}
    for path, text, linked in found:
        if not _ARTICLE.search(path):
            n, links, code = sums.get(path, (0, 0, 0))
            sums[path] = n + len(text), links + linked, zlib.crc32(text.encode("utf-8", "replace"), code)
    return {path: (n, code) for path, (n, links, code) in sums.items() if 2 * links > n}


def scored(found: list[Block]) -> dict[str, tuple[int, int]]:
    """The characters below each path and a hash of them; the empty path has all.

    Paths end at the first article or main. The blocks that lie in a container itself, not in one
    further down, have that container's path and a slash; where they are mostly links they do not count.
    """
    own: dict[str, tuple[int, int]] = {}
    skipped = mostly_links(found)
    for path, text, _ in found:
        if path not in skipped:
            n, code = own.get(path, (0, 0))
            own[path] = n + len(text), zlib.crc32(text.encode("utf-8", "replace"), code)
    below: dict[str, tuple[int, int]] = {}
    for path, (size, code) in own.items():
        top = _ARTICLE.search(path)
        steps = (path[: top.end()] if top else path + "/").split("/")
        for depth in range(1, len(steps) + 1):
            key = "/".join(steps[:depth])
            n, old = below.get(key, (0, 0))
            below[key] = n + size, (old * 31 + code) & 0xFFFFFFFF
    return below


def marked(path: str) -> list[str]:
    """The path's containers that are left out by name, outermost first."""
    steps = path.split("/") if MARK in path else []
    return ["/".join(steps[: k + 1]) for k, step in enumerate(steps) if step.startswith(MARK)]


def named_shares(found: list[Block]) -> dict[str, int]:
    """The share of the characters, in thousandths, below each container that is left out by name."""
    total = sum(len(text) for _, text, _ in found)
    below: Counter = Counter()
    for path, text, _ in found:
        for container in marked(path):
            below[container] += len(text)
    return {path: 1000 * n // total for path, n in below.items()}


def unexcluded(found: list[Block], lifted: Collection[str]) -> list[Block]:
    """The blocks that lie in no container left out by name but those ``lifted``."""
    return [b for b in found if MARK not in b[0] or all(m in lifted for m in marked(b[0]))]


def own_blocks(found: list[Block]) -> list[Block]:
    """As ``unexcluded``, where a page lifts the containers that hold most of its own text."""
    return unexcluded(found, {path for path, n in named_shares(found).items() if n >= WINNING})


def own_path(found: list[Block]) -> str:
    """The winning path of a page by itself."""
    sizes, path = {k: n for k, (n, _) in scored(found).items()}, ""
    while sizes:
        children = {k: n for k, n in sizes.items() if k and k.rpartition("/")[0] == path}
        big = [k for k, n in children.items() if not k.endswith("/") and 1000 * n >= WINNING * sizes[""]]
        beside = {path + "/"} if big and _ARTICLE.search(big[0]) else set(children) - set(big)
        if not big or beside & set(children):
            break
        path = big[0]
    return path


def lies_below(path: str, chosen: str) -> bool:
    return path == chosen or path.startswith(chosen + "/")


def main_text(
    html: str | None, path: str, lifted: Collection[str] = (), repeated: Collection[str] = (), menus: Collection[str] = ()
) -> str:
    """The blocks below a path, or below the page's own path if they are too small a share of the page.

    ``lifted`` containers are the host's that count in spite of their names, ``repeated`` ones those
    beside its path whose text it repeats, ``menus`` those whose links it repeats.
    """
    found = unexcluded(blocks(html), lifted)
    links = mostly_links(found)
    found = [b for b in found if not (b[0] in links and b[0] in menus)]
    chosen = [b for b in found if lies_below(b[0], path)]
    others = [b for b in found if lies_below(b[0], path) or not any(b[0] + "/" == k or lies_below(b[0], k) for k in repeated)]
    of_text, of_page = (sum(len(text) for own, text, _ in part if own not in links) for part in (chosen, others))
    if of_text * 1000 < WINNING * of_page or not chosen:
        others = others or found
        best = own_path(others)
        chosen = [b for b in others if lies_below(b[0], best)]
    return "\n".join(text for _, text, _ in chosen)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path, lifted, repeated, menus): the winning path of every host, and what it needs to be applied.

    Lifted are containers that count in spite of their names: they hold, on average over the pages
    where they occur, as much of the text as a winner needs. Repeated are those beside the way to
    the winner that have, over all addresses, at most half as many different texts. Menus are containers of links that do so anywhere.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = blocks(html)
                address = zlib.crc32(url.encode("utf-8", "replace"))
                own = own_blocks(found)
                shares = scored(own)
                total = shares.get("", (0, 0))[0]
                rows += [(host, path, "text", 1000 * n // total, code, address) for path, (n, code) in shares.items()]
                rows += [(host, path, "named", share, 0, address) for path, share in named_shares(found).items()]
                rows += [(host, path, "links", 0, code, address) for path, (_, code) in mostly_links(own).items()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "kind", "share", "code", "address"])

    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)[?#].*", "")
    cast = pages.select(host_of(F.col("url")).alias("host"), address.alias("url"), F.col("html"))
    cast = cast.mapInArrow(task, "host string, path string, kind string, share long, code long, address long")
    sums = cast.groupBy("host", "path", "kind").agg(
        F.sum("share").alias("votes"),
        F.count("*").alias("pages"),
        F.approx_count_distinct("code", ERROR).alias("texts"),
        F.approx_count_distinct("address", ERROR).alias("addresses"),
    )
    sums = checkpointed(sums)
    lifted = sums.filter((F.col("kind") == "named") & (F.col("votes") >= F.col("pages") * WINNING))
    lifted = lifted.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("lifted"))
    menus = sums.filter("kind = 'links' AND texts * 2 <= addresses")
    menus = menus.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("menus"))
    sums = sums.filter("kind = 'text'")
    possible = sums.filter("path = ''").select("host", F.col("votes").alias("possible"), F.col("pages").alias("all"))
    direct, article = F.col("path").endswith("/"), F.col("path").rlike(r"/(article|main)(\.[^/]*)?$")
    scores = sums.join(possible, "host").select(
        "host",
        "path",
        F.when(F.col("path") != "", F.regexp_replace("path", "/[^/]*$", "")).alias("parent"),
        (F.size(F.split("path", "/"))).alias("depth"),
        (~direct & (F.col("votes") * 1000 >= F.col("possible") * WINNING)).alias("big"),
        direct.alias("direct"),
        article.alias("article"),
        (F.col("pages") * 2 > F.col("all")).alias("usual"),
        ((F.col("votes") < F.col("pages") * 500) & (F.col("texts") * 2 <= F.col("addresses"))).alias("repeated"),
    )
    other = F.expr("NOT big AND usual AND NOT repeated")
    below = scores.filter("parent IS NOT NULL").groupBy("host", F.col("parent").alias("path"))
    below = below.agg(
        F.expr("bool_or(big AND article)").alias("to_article"),
        F.bool_or(other).alias("other"),
        F.bool_or(other & F.col("direct")).alias("other_direct"),
        F.collect_set(F.when(F.expr("repeated AND NOT big"), F.col("path"))).alias("repeated"),
    )
    way = scores.filter("big").select("host", "path", "depth").join(below, ["host", "path"], "left")
    ends = F.expr("other_direct OR (other AND NOT to_article)")
    step = F.struct("depth", "path")
    winners = way.groupBy("host").agg(
        F.coalesce(F.min(F.when(ends, step)), F.max(step))["path"].alias("path"),
        F.sort_array(F.flatten(F.collect_list("repeated"))).alias("repeated"),
    )
    return winners.join(lifted, "host", "full").join(menus, "host", "full")


#: What a host's winner needs to be applied; none for a host without text.
_LISTS = ["lifted", "repeated", "menus"]
_NO_WINNER = ("", (), (), ())


def _winner(row) -> tuple:
    return (row["path"] or "", *(tuple(row[n] or ()) for n in _LISTS))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, path.

    Up to ``BROADCAST_CHARS`` characters of winners go to every worker once; more are joined by host,
    and come with each page.
    """
    winners = checkpointed(consensus(pages))
    chars = F.length("host") + F.length(F.coalesce("path", F.lit(""))) + F.length(F.concat_ws("", *_LISTS))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    names = ["page_id", "url", "text", "n_chars", "path"]
    schema = "page_id long, url string, text string, n_chars long, path string"

    def result(ids, urls, htmls, chosen: Iterable[tuple]) -> pa.RecordBatch:
        chosen = list(chosen)
        texts = [main_text(h, *w) for h, w in zip(htmls.to_pylist(), chosen)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        shown = pa.array([w[0].replace("/" + MARK, "/") for w in chosen], pa.string())
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), sizes, shown], names)

    if (winners.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS:
        by_host = pages.sparkSession.sparkContext.broadcast({r["host"]: _winner(r) for r in winners.collect()})

        def start_known():
            def work(ids, urls, htmls, hosts):
                return result(ids, urls, htmls, (by_host.value.get(h, _NO_WINNER) for h in hosts.to_pylist()))

            return work

        return map_rows(rows, ["page_id", "url", "html", "host"], start_known, schema)

    def start():
        def work(ids, urls, htmls, path, *lists):
            given = (dict(zip(["path", *_LISTS], w)) for w in zip(*(c.to_pylist() for c in (path, *lists))))
            return result(ids, urls, htmls, map(_winner, given))

        return work

    return map_rows(rows.join(winners, "host", "left"), ["page_id", "url", "html", "path", *_LISTS], start, schema)

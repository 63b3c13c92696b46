"""HTML extraction by template deduction: classes of tokens that occur alike on the pages of a host.

A token is a container tag with its path from the top (so the same tag in two places is two tokens), or a
block's text with its path. A token's occurrence vector says how often it stands on each page of the host. Vectors are
never built: every page adds a hash of itself and the count to each of its tokens by XOR, so that tokens with the same vector get
the same fingerprint, whatever the number of pages and however they are spread. Tokens of one fingerprint are a
class. A class is valid if it is on at least ``share`` of the host's pages and holds ``tokens`` tokens or more, or nests
in a valid one: its containers' parents are in a valid class. Valid classes make the template; the places between
its tokens are the slots.

Per host, the slot that holds the article is the article container of the template, or the main container if that holds more than twice
the words; else the container with the most words that aren't template text. From each page the text of that slot is taken and nothing
outside it, without slots that are boilerplate by kind (navigation, header, footer, adverts, forms, scripts, reader comments and
the like), and without containers in it that are template alone: on ``pages`` pages at least, with no text but such as has the
container's own occurrence vector. Text that repeats beside the article's own in one container stays. A page without that slot, as on a
host without a template, gives its own article or main containers, else all that isn't boilerplate.

A container is boilerplate by name only if all words of a whole class token or id are on the list (``cookie-banner``, not ``no-sidebar``). An
article or main container counts whatever it stands in; one inside a boilerplate container competes by its words with what isn't
boilerplate. No page with words in an article or main container gives an empty text.

Skew: sums over ``(host, token)`` are partial in each task, and the template is one row a host, joined to its
pages; a host with a third of all pages is a skewed join that Spark splits, never one group in one task.

Edge cases: a null html is empty and gives an empty text; a null or odd url has the host '' shared with its like;
unclosed, unopened and cut-off tags, cells and rows of tables without end tags, and cut-off character references, are read as browsers do;
formulas and drawings are inline text; a repeated row is a page of its own. A very long page takes time and memory in proportion to its length:
equal paths are one text, elements are nested ``DEEPEST`` deep at most, and long class names stand in paths by their hash. Other columns are
passed on as they are.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.session import stage


@dataclass(frozen=True)
class Template:
    share: float = 0.5
    tokens: int = 3
    pages: int = 5


# Kinds of elements of the HTML standard, and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes select".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure details blockquote dialog menu fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary legend caption option br head title".split())
BOILERPLATE = frozenset("head nav header footer aside form menu dialog button fieldset label".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies footer"
    " header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply"
    " share sharing sidebar social sponsor sponsored subscribe widget widgets".split()
)
REPLY_WORDS = frozenset("comment comments reply replies".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ENDS_P = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address".split())
#: Start tags that end open elements before them, and the containers beyond which they don't reach.
ENDS = {
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    "tr": (frozenset(("td", "th", "tr")), frozenset(("table", "thead", "tbody", "tfoot"))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("td", "th", "tr", "thead", "tbody", "tfoot")), frozenset(("table",)))),
}
LONGEST_NAME = 128
#: Elements are nested no deeper by browsers either; what is opened below stands beside.
DEEPEST = 512
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z))", re.S)
# Whole attributes, so that neither the end of a name nor a word in a value is taken for one.
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    path: str
    main: bool
    dropped: bool
    #: In an article or main container that stands in boilerplate.
    rescued: bool
    text: str


def _kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A container's name in paths, whether it is boilerplate, and whether it is a main container."""
    name, tokens, role = tag, [], ""
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            role = value.strip()
        elif kind in ("class", "id"):
            tokens += [set(_NAME.findall(token)) for token in value.split()]
            if kind == "class":
                name = f"{tag}.{'.'.join(value.split())}"
                name = name if len(name) <= LONGEST_NAME else f"{tag}.{xxhash.xxh3_128_hexdigest(name)}"
    if tag in ("html", "body", "main"):
        return name, False, tag == "main"
    if tag == "article":
        return name, any(words and words <= REPLY_WORDS for words in tokens), True
    named = any(words and words <= BOILERPLATE_WORDS for words in tokens)
    return name, role != "main" and (tag in BOILERPLATE or role in BOILERPLATE_ROLES or named), role == "main"


def blocks(page: str) -> tuple[list[Block], dict[str, int], dict[str, int]]:
    """A page's blocks of text in order, how often each container path opens, and the rank of article (3) and main (2) containers."""
    out: list[Block] = []
    paths: dict[str, int] = {}
    mains: dict[str, int] = {}
    known: dict[str, str] = {}  # one text for equal paths
    held: list[str] = []
    # Open elements: tag, path, inside a main container, dropped, rescued.
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]

    def flush():
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, main, dropped, rescued = stack[-1]
                out.append(Block(path, main, dropped, rescued, text))

    def end_implied(ended: frozenset, inside: frozenset):
        cut = len(stack)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in inside:
                break
            if stack[k][0] in ended:
                cut = k
        del stack[cut:]

    def close(tag: str):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCKS:
            if tag == "br":
                held.append(" ")
            else:
                flush()
        if stack[-1][0] == "head" and not ending and tag not in HEAD_ONLY:
            stack.pop()
        if ending:
            close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and stack[-1][0] == "p":
            stack.pop()
        if tag == "li" and stack[-1][0] == "li":
            stack.pop()
        if tag == "body":
            close("head")
        if tag in ENDS:
            end_implied(*ENDS[tag])
        if len(stack) >= DEEPEST and (tag in CONTAINERS or tag in BOILERPLATE or tag in ("p", "li")):
            stack.pop()
        _, path, main, dropped, rescued = stack[-1]
        if tag in CONTAINERS or tag in BOILERPLATE:
            name, boilerplate, is_main = _kind(tag, attributes)
            path = f"{path}>{name}"
            path = known.setdefault(path, path)
            paths[path] = paths.get(path, 0) + 1
            # Replies inside an article stay dropped, as do teasers inside its boilerplate.
            if is_main and dropped and not boilerplate and not main:
                dropped, rescued = False, True
            main, dropped = main or is_main, dropped or boilerplate
            if is_main and not dropped:
                mains[path] = 1 if rescued else 3 if tag == "article" else 2
            stack.append((tag, path, main, dropped, rescued))
        elif tag in ("p", "li"):
            stack.append((tag, path, main, dropped, rescued))
    flush()
    return out, paths, mains


def chosen(page: str, main_path: str | None, fixed: list[str] | None = None) -> str:
    """The page's text: the host's slot without its ``fixed`` containers, else the page's own article, else all that isn't boilerplate."""
    found, _, _ = blocks(page)
    left = [b for b in found if not b.dropped]
    slot = [b for b in left if b.path == main_path or b.path.startswith(main_path + ">")] if main_path else []
    slot = [b for b in slot if b.path not in fixed] if fixed else slot
    plain, rescued = [b for b in left if not b.rescued], [b for b in left if b.rescued]
    if not slot and not (slot := [b for b in plain if b.main]):
        slot = max(plain, rescued, key=lambda part: sum(len(b.text.split()) for b in part)) or [b for b in found if b.main]
    return " ".join(b.text for b in slot)


def host(url):
    """The host of a url, in lower case, without port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# ``token`` of a container is the hash of its path, and ``parent`` that of the container it stands in; only containers carry the path.
_TOKENS = T.StructType([
    T.StructField("host", T.LongType()), T.StructField("token", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("vector", T.LongType()), T.StructField("pages", T.LongType()), T.StructField("words", T.LongType()), T.StructField("rank", T.IntegerType()),
])
_KINDS = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3 + [pa.int32()]


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def page_tokens(page: str, mark: int) -> list[tuple]:
    """A page's tokens as rows of ``_TOKENS`` without the host; ``mark`` stands for the page."""
    found, paths, mains = blocks(page)
    plain = {b.path for b in found if not b.dropped}
    out = [
        (_hash(path), _hash(path.rpartition(">")[0]), path, _hash(f"{mark} {c}"), 1, 0, mains.get(path, int(path in plain)))
        for path, c in paths.items()
    ]
    texts: dict[tuple[str, str], int] = {}
    for b in found:
        texts[b.path, b.text] = texts.get((b.path, b.text), 0) + 1
    out += [(_hash(f"{path}\0{text}"), _hash(path), None, _hash(f"{mark} {c}"), 1, c * len(text.split()), 0) for (path, text), c in texts.items()]
    return out


def _tokens(batches):
    """Tokens of the pages, those of a host summed for each batch: vectors by XOR, pages and words by addition."""
    for batch in batches:
        sums: dict[tuple[int, int], list] = {}
        for name, mark, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for token, parent, path, vector, n, words, rank in page_tokens(html or "", mark):
                row = sums.get((name, token))
                if row is None:
                    sums[name, token] = [parent, path, vector, n, words, rank]
                else:
                    row[2] ^= vector
                    row[3] += n
                    row[4] += words
                    row[5] = max(row[5], rank)
        cols = list(zip(*[(*k, *v) for k, v in sums.items()], strict=True)) if sums else [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_TOKENS.names)


def templates(pages: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each host with a template: ``host`` (hashed), ``main_path``, the container of its article slot, and ``fixed``, containers in that which are template alone."""
    keyed = pages.select(F.xxhash64(host(F.col("url"))).alias("host"), F.xxhash64("page_id", "url", F.xxhash64("html")).alias("page"), "html")
    sums = [F.max("path").alias("path"), F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("words").alias("words"), F.max("rank").alias("rank")]
    tokens = keyed.mapInArrow(_tokens, _TOKENS).groupBy("host", "token", "parent").agg(*sums)
    # Texts of one page are no template; only their words are kept, as one row of each container.
    single = F.col("path").isNull() & (F.col("pages") == 1)
    tokens = stage(tokens.withColumn("token", F.when(~single, F.col("token"))).groupBy("host", "token", "parent").agg(*sums), "template-tokens")
    sizes = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = F.col("token").isNotNull() & (F.col("pages") >= template.share * F.col("all"))
    common = tokens.join(sizes, "host").where(often)
    classes = common.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= template.tokens)
    containers = common.where("path is not null").join(classes, ["host", "vector", "pages"], "left").withColumn("valid", F.col("size").isNotNull())
    parents = containers.where("valid").select("host", F.col("token").alias("parent"), F.lit(True).alias("nests"))
    nested = containers.join(parents, ["host", "parent"], "left").where("valid or nests").select("host", "token", "path", "rank", "vector", "pages")
    # Words of a container that aren't template text, in it (own) and in it or below it (words).
    free = tokens.where("path is null").join(sizes, "host").where(~often).groupBy("host", F.col("parent").alias("token")).agg(F.sum("words").alias("own"))
    placed = free.join(tokens.where("path is not null").select("host", "token", "path"), ["host", "token"])
    steps = F.expr("transform(sequence(1, size(split(path, '>')) - 1), k -> concat_ws('>', slice(split(path, '>'), 1, k + 1)))")
    below = placed.select("host", F.explode(steps).alias("path"), "own").groupBy("host", "path").agg(F.sum("own").alias("words"))
    scored = nested.where("rank > 0").join(free, ["host", "token"], "left").join(below, ["host", "path"], "left")
    # An article or main container with less than half the words of another one isn't the slot.
    top = F.max(F.when(F.col("rank") > 1, F.coalesce("words", F.lit(0)))).over(Window.partitionBy("host"))
    scored = scored.withColumn("top", top).where("rank = 1 or 2 * coalesce(words, 0) >= top")
    told = F.when(F.col("rank") == 1, F.coalesce("own", F.lit(0))).otherwise(F.coalesce("words", F.lit(0)))
    best = F.max_by(F.struct("path", F.coalesce("words", F.lit(0)).alias("words")), F.struct("rank", told, F.coalesce("words", F.lit(0)), "path"))
    slots = scored.groupBy("host").agg(best.alias("slot")).select("host", F.col("slot.path").alias("main_path"), F.col("slot.words").alias("varying"))
    # Containers all of whose own texts are in their class, in a slot whose words vary (not that of a host of copies).
    inner = nested.join(slots.where("varying > 0"), "host").where(F.col("pages") >= template.pages).where("startswith(path, main_path || '>')")
    inner = inner.select("host", F.col("token").alias("parent"), "path", F.col("vector").alias("whole"), F.col("pages").alias("on"))
    texts = tokens.where("path is null").select("host", "parent", "token", "vector", "pages").join(inner, ["host", "parent"])
    alike = F.bool_and(F.coalesce(F.expr("token is not null and vector = whole and pages = on"), F.lit(False)))
    fixed = texts.groupBy("host", "path").agg(alike.alias("alike")).where("alike").groupBy("host").agg(F.collect_list("path").alias("fixed"))
    return slots.select("host", "main_path").join(fixed, "host", "left")


@F.arrow_udf(T.StringType())
def _extracted(pages: pa.Array, mains: pa.Array, fixed: pa.Array) -> pa.Array:
    return pa.array([chosen(p, m, f) if p else "" for p, m, f in zip(pages.to_pylist(), mains.to_pylist(), fixed.to_pylist(), strict=True)], pa.string())


def extracted(pages: DataFrame, template: Template = Template()) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and the host's ``main_path`` for each row of ``pages``."""
    found = stage(templates(pages, template).select(F.col("host").alias("host__"), "main_path", "fixed"), "templates")
    rows = pages.select("page_id", "url", "html").withColumn("host__", F.xxhash64(host(F.col("url")))).join(found, "host__", "left")
    texts = rows.select("page_id", "url", "main_path", _extracted("html", "main_path", "fixed").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "main_path")

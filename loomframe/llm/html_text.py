"""Main text of web pages by nearest-URL differencing.

Each page is cut into text lines.  Pages of one host with the same lines are one class; the classes are numbered by
(host, path), which ranges of them do in parallel, and neighbours meet by a join on the number, so that slices of the
order do not matter; only 64-bit hashes of the lines travel for it.  A class's lines are aligned with those of the
neighbour of its host that has the longer common path (longest common subsequence, by bits, in bounded memory), and lines
that both have are deleted, also inside articles and main regions; only a region
whose lines all stand in the neighbour is a copy and kept whole.  Lines inside menus, headers, footers, sidebars, notices,
adverts, forms and comments are dropped although the neighbour lacks them.

Defined cases: a null html is empty and gives an empty text; a null url, or one without a host, belongs to host '';
pages with the same lines have the same text; a page whose host has no other lines is only cleaned by its mark-up; an
empty table gives no rows; other columns are not read.  Unclosed tags, stray brackets and references without a semicolon
are read as browsers read them.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frame import with_rows
from .common import cut

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style template noscript iframe object svg math canvas audio video noembed noframes xmp textarea title".split())
#: Elements that are never part of an article.
ASIDE = frozenset("nav footer aside form menu button select dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
LAYOUT = frozenset("site page main global top bottom left right primary secondary".split())
#: Elements that are judged by their name and not by their marks.
WHOLE = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Where a line stands.
ASIDE_LINE, BODY_LINE, MAIN_LINE, ARTICLE_LINE = range(4)
#: While a page is read: within an element whose class is a mark; in an article there, which counts if there is no other.
HIDDEN_LINE, WRAPPED_LINE = -1, 4


def _named(name: str) -> bool:
    """Whether a class or id is a mark, or begins with one after words of layout."""
    if name in MARKS:
        return True
    tokens = re.split(r"[_-]+", name)
    return next((t in MARKS for t in tokens if t not in LAYOUT), False)


def _marked(attributes: str) -> str:
    """'class' or 'role' where class or id, or else role or hiding, name something other than content; '' otherwise."""
    out = ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return "role"
        if name in ("class", "id") and any(map(_named, value.split())):
            out = "class"
    return "role" if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) else out


def lines_of(page: str) -> list[tuple[int, str]]:
    """(where, text) of each line with text, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    opened: list[tuple[str, int]] = []  # containers, and where their lines stand
    where, at, size = BODY_LINE, 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((where, text))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            flush() if name in BLOCKS else None
            if end and not attributes.endswith("/"):
                at = page.find(">", end.start())
                at = size if at < 0 else at + 1
            elif name in ("script", "style"):
                at = size
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID and name != "hr" or name not in BLOCKS and not (closing and any(n == name for n, _ in opened)):
            if not closing and name not in VOID and where > ASIDE_LINE and attributes and _marked(attributes):
                flush()
                opened.append((name, where))
                where = ASIDE_LINE
            elif not closing and name in ASIDE:
                flush()
                opened.append((name, where))
                where = ASIDE_LINE
            continue
        flush()
        if closing:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == name:
                    where = opened[k][1]
                    del opened[k:]
                    break
            continue
        if name in ("p", "hr"):
            if where > ASIDE_LINE and name == "p" and _marked(attributes):
                opened.append((name, where))
                where = ASIDE_LINE
            continue
        opened.append((name, where))
        mark = _marked(attributes)
        if name == "body":
            where = BODY_LINE
        elif name == "article" and where == HIDDEN_LINE and not mark:
            where = WRAPPED_LINE
        elif name == "article" and ASIDE_LINE < where < WRAPPED_LINE:
            where = ARTICLE_LINE
        elif name in ASIDE or name == "header" and ASIDE_LINE <= where < MAIN_LINE or mark == "role" and name not in WHOLE:
            where = ASIDE_LINE
        elif mark and name not in WHOLE:
            where = HIDDEN_LINE if where in (BODY_LINE, MAIN_LINE, HIDDEN_LINE) else ASIDE_LINE
        elif where == BODY_LINE and (name == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes or "")):
            where = MAIN_LINE
    flush()
    wrapped = ASIDE_LINE if any(w == ARTICLE_LINE for w, _ in out) else ARTICLE_LINE
    return [(wrapped if w == WRAPPED_LINE else max(w, ASIDE_LINE), t) for w, t in out]


def common(a: list, b: list) -> list[bool]:
    """Which items of a stand in one longest common subsequence of a and b (bits of whole numbers as the table's rows)."""
    out = [False] * len(a)
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        out[low] = True
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        out[-1 - end] = True
        end += 1
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    out[low : len(a) - end] = _aligned(x, y)
    return out


#: Bits of the table of one alignment (16 MB); larger ones are cut in two where a longest subsequence passes.
MOST_BITS = 1 << 27


def _aligned(x: list, y: list) -> list[bool]:
    if len(x) > 1 and len(x) * len(y) > MOST_BITS:
        half = len(x) // 2
        ahead = _lengths(_rows(x[:half], y, False)[-1], len(y))
        behind = _lengths(_rows(x[half:][::-1], y[::-1], False)[-1], len(y))
        cut_ = int(np.argmax(ahead + behind[::-1]))
        return _aligned(x[:half], y[:cut_]) + _aligned(x[half:], y[cut_:])
    out, rows = [False] * len(x), _rows(x, y, True)
    j = len(y) - 1
    for i in range(len(x) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:  # no longer with y[j] than without
            j -= 1
        if j < 0:
            break
        if i and not rows[i - 1] >> j & 1:
            continue
        out[i] = True
        j -= 1
    return out


def _rows(x: list, y: list, every: bool) -> list[int]:
    """The table's rows, or the last one: bit j is 0 where the subsequence with y[: j + 1] is longer than with y[:j]."""
    places: dict = {item: [] for item in x}
    for j, item in enumerate(y):
        if item in places:
            places[item].append(j)
    few = len(places) * len(y) <= MOST_BITS  # else a mask is made where it is needed
    masks = {item: _bits(at, len(y)) for item, at in places.items()} if few else {}
    full = (1 << len(y)) - 1
    rows, v = [], full
    for item in x:
        u = v & (masks[item] if few else _bits(places[item], len(y)))
        v = (v + u | v - u) & full
        if every:
            rows.append(v)
    return rows if every else [v]


def _bits(places: list[int], n: int) -> int:
    flags = np.zeros(n, dtype=np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _lengths(row: int, n: int) -> np.ndarray:
    """Longest subsequences with y[:0], y[:1], ... of a table's row."""
    flags = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - flags.astype(np.int64))])


def kept(where: list[int], shared: list[bool]) -> list[bool]:
    """Of the lines of the best region: whether the neighbour lacks them, or the whole marked region is a copy."""
    best = max(where, default=ASIDE_LINE)
    own = [s for w, s in zip(where, shared, strict=True) if w == best]
    if best > BODY_LINE and all(own):
        return [True] * len(own)
    return [best > ASIDE_LINE and not s for s in own]


def _alike(a: str, b: str) -> int:
    n = 0
    for p, q in zip(a, b, strict=False):
        if p != q:
            break
        n += 1
    return n


def extract(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """_id, _url and text of each page."""
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), url.alias("_url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"), host.alias("_host"), path.alias("_path"))
    keyed = cut(_parsed(rows, True))
    # pages of a host with equal lines are one class, which stands where its first page does
    first = keyed.groupBy("_host", "_same").agg(F.min(F.struct("_path", "_id", "_lines")).alias("f")).select("_host", "_same", F.col("f._path").alias("_path"), F.col("f._id").alias("_first"), F.col("f._lines").alias("_lines"))
    placed = with_rows(first, ["_host", "_path", "_first", "_same"], "_row").drop("_first")
    near = [placed.select((F.col("_row") + by).alias("_row"), *(F.col(f"_{c}").alias(f"_{c}{by}") for c in ("host", "path", "lines"))) for by in (1, -1)]
    both = placed.join(near[0], "_row", "left").join(near[1], "_row", "left")
    done = _differenced(both.select("_host", "_same", "_path", "_lines", *(F.col(f"_{c}{by}") for by in (1, -1) for c in ("host", "path", "lines"))))
    a, b = _parsed(rows, False).alias("a"), done.alias("b")
    own = a.join(b, (F.col("a._host") == F.col("b._host")) & (F.col("a._same") == F.col("b._same")))
    text = F.array_join(F.filter(F.split("_text", "\n"), lambda _, i: F.coalesce(F.get("_kept", i), F.lit(False))), "\n")
    return own.select("_id", "_url", text.alias("text"))


def _parsed(rows: DataFrame, keys: bool) -> DataFrame:
    """_same: a hash of each page's lines; with keys, _lines: where each line stands and its hash, else _text: the lines of the best region."""

    def run(batches):
        import xxhash

        for batch in batches:
            same, more = [], []
            for page in batch.column(4).to_pylist():
                lines = lines_of(page)
                where = bytes(w for w, _ in lines)
                raw = where + np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for _, t in lines], dtype="<u8").tobytes()
                same.append(hashlib.blake2b(raw, digest_size=16).digest())
                more.append(raw if keys else "\n".join(t for w, t in lines if w == max(where)))
            columns = [batch.column(k) for k in ((0, 2, 3) if keys else (0, 1, 2))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(same, pa.binary()), pa.array(more, pa.binary() if keys else pa.string())], names=["_id", *(("_host", "_path") if keys else ("_url", "_host")), "_same", "_lines" if keys else "_text"])

    return rows.select("_id", "_url", "_host", "_path", "_html").mapInArrow(run, "_id long, _host string, _path string, _same binary, _lines binary" if keys else "_id long, _url string, _host string, _same binary, _text string")


def _differenced(pairs: DataFrame) -> DataFrame:
    """_kept of each class, against the neighbour of its host with the longer common path."""

    def run(batches):
        for batch in batches:
            out = []
            for host, _, path, own, *others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, mine = own[: len(own) // 9], np.frombuffer(own, "<u8", offset=len(own) // 9).tolist()
                near = [(p, np.frombuffer(x, "<u8", offset=len(x) // 9).tolist()) for h, p, x in (others[:3], others[3:]) if h == host]
                # the same text under other mark-up says nothing
                other = max((o for o in near if o[1] != mine), key=lambda o: _alike(o[0], path), default=None)
                out.append(kept(list(where), common(mine, other[1]) if other else [False] * len(mine)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.bool_()))], names=["_host", "_same", "_kept"])

    return pairs.mapInArrow(run, "_host string, _same binary, _kept array<boolean>")

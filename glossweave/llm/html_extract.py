"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one for each block. Menus, headers, footers, sidebars, notices, adverts,
forms, comment lists, scripts and styles leave a gap of empty lines; other empty lines go. Every line has a
weight: the length of its text, or nothing where most of it is link text. Tags are priors on it: on a page with
articles (`article` or `main`), lines of the one with most text weigh three times their length and `LEAST` more,
all others a fifth, and a gap parts the two. The weights are summed over a sliding window of lines. Where the
sums leave zero and reach `LEAST` (or the fullest window, if that is less) they surge, where they
fall to zero again they dive. The text from surge to dive is kept; outside the article only if it weighs at least `SHARE` of the heaviest
such stretch.

What the class, id and role of an element say drops it outside an article. Inside one, elements that hold text
(paragraphs, headings, list items and the like) stay whatever their class; a container goes if its class names
an advert, a notice of cookies, comments or the like in whole words, and link lines of containers that may be
extras (`related`, `share`) weigh nothing anyhow.

Defined cases: null or empty html gives an empty text; text outside any tag counts as a block; elements that
are never closed end at their parent's end, and unwanted ones of these also where an article begins; ties between
equally long articles go to the first; repeated rows are handled alike; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

WINDOW = 3
SHARE = 0.15
LEAST = 40
INSIDE, OUTSIDE = 3.0, 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|[^>]*>?)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr caption ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form menu dialog head button search dir label fieldset".split())
_LOOSE = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|adsense|advertising|adbox|banners?|sponsor(?:ed|s)?|promo(?:tion|tions|s)?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe"
    r"|subscription|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|topbar|toolbar|masthead|footer|foot|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommend(?:ed|ations?)?"
    r"|widgets?|paginat(?:ion|or)|pager|copyright|disclaimer|signup|login|searchbox|searchform|skip|teasers?|tags|outbrain|taboola|hidden)(?=$|[\s_-])",
    re.I,
)
_HEAD_HINT = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
#: Class words that drop a container inside an article.
_JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored cookie cookies cookie-notice cookie-banner consent gdpr popup modal overlay newsletter subscribe sidebar navbar navigation breadcrumb breadcrumbs"
    " comment comments comment-list commentlist comments-area disqus respond replies pagination signup login outbrain taboola hidden".split()
)
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre span b i em strong a td th tr dt dd figcaption caption tbody thead table".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in _DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    if _HIDDEN.search(attributes):
        return True
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if kind.lower() == "role":
            if value.lower() in _ROLES:
                return True
        elif inside:
            if name not in _TEXT and not _JUNK.isdisjoint(value.lower().split()):
                return True
        elif _HINT.search(value) or _HEAD_HINT.search(value):
            return True
    return False


_CLOSES_P = _BLOCKS - {"body", "tr", "td", "tbody", "thead", "tfoot", "caption", "legend", "summary", "html"}


def _closings(tokens: list) -> dict[int, int]:
    """Start tag's index to the index where its element ends: its end tag, or where its parent ends."""
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    closed: dict[int, int] = {}

    def pop(k: int) -> str:
        name, at = stack.pop()
        count[name] -= 1
        closed[at] = k
        return name

    for k, (_, _, end, name, _) in enumerate(tokens):
        if name is None or name in _VOID:
            continue
        if end:
            if count.get(name):
                while pop(k) != name:
                    pass
        else:
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                pop(k)
            elif name in ("li", "option", "dt", "dd") and stack and stack[-1][0] in (("dt", "dd") if name[0] == "d" else (name,)):
                pop(k)
            stack.append((name, k))
            count[name] = count.get(name, 0) + 1
    while stack:
        pop(len(tokens))
    return closed


class _Line:
    __slots__ = ("parts", "linked", "path", "gap")

    def __init__(self, path: tuple[int, ...], gap: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        self.path = path
        self.gap = gap


def lines_of(source: str) -> tuple[list[tuple[str, int, tuple[int, ...], bool]], list[int]]:
    """Lines (text, length of its link text, indices of the articles around it, whether it stands for a dropped
    element); all article indices."""
    tokens = []
    for m in _TOKEN.finditer(source):
        name = m.group(3)
        tokens.append((m.start(), m.end(), bool(m.group(2)), name.lower() if name else None, m.group(4) or ""))
    closed = _closings(tokens)
    articles = [k for k, t in enumerate(tokens) if t[3] in ("article", "main") and not t[2]]
    lines: list[_Line] = []
    zones: list[int] = []
    around: list[tuple[int, int]] = []
    current, at, skip, link, ahead = _Line(()), 0, -1, 0, 0
    for k, (begin, stop, end, name, attributes) in enumerate(tokens):
        if skip >= 0 and k >= skip:
            skip = -1
            at = max(at, begin)
        if skip < 0 and begin > at:
            piece = source[at:begin]
            current.parts.append(piece)
            if link:
                current.linked += len(piece.strip())
        at = stop
        while around and k >= around[-1][1]:
            around.pop()
        path = tuple(z for z, _ in around)
        if name is None:
            if skip < 0 and source[begin + 1 : begin + 2] not in "!?":
                current.parts.append(" ")
            continue
        if skip >= 0:
            continue
        if not end and name not in _VOID and _unwanted(name, attributes, bool(around)):
            skip = closed[k]
            if skip >= len(tokens) or not (tokens[skip][2] and tokens[skip][3] == name):  # never closed
                while ahead < len(articles) and articles[ahead] <= k:
                    ahead += 1
                if ahead < len(articles):
                    skip = min(skip, articles[ahead])
            lines += [current, _Line(path, True)]
            current = _Line(path)
        elif name == "a":
            link = 0 if end else 1
        elif name in _BLOCKS:
            lines.append(current)
            if not end and name in ("article", "main"):
                zones.append(k)
                around.append((k, closed[k]))
                path = tuple(z for z, _ in around)
            current = _Line(path)
        elif name in ("br", "td", "th", "img"):
            current.parts.append(" ")
    if skip < 0:
        current.parts.append(source[at:])
    lines.append(current)
    return [(" ".join(html.unescape("".join(x.parts)).split()), x.linked, x.path, x.gap) for x in lines], zones


def main_text(source: str | None, window: int = WINDOW, share: float = SHARE, use_articles: bool = True) -> str:
    """The blocks of the main text, joined by an empty line. Without `use_articles` the distribution has no prior."""
    lines, zones = lines_of(source or "")
    best = None
    if zones and use_articles:
        sizes = dict.fromkeys(zones, 0)
        for t, _, path, _ in lines:
            for z in path:
                sizes[z] += len(t)
        best = max(zones, key=lambda z: (sizes[z], -z))
        best = best if sizes[best] else None
    texts: list[str] = []
    weights: list[float] = []
    inside: list[bool] = []
    for t, linked, path, gap in lines:
        inner = best is None or best in path
        weight = len(t) if 2 * linked <= len(t) else 0
        if best is not None and weight:
            weight = INSIDE * weight + LEAST if inner else OUTSIDE * weight
        if gap or inside and inside[-1] != inner:
            texts += [""] * window
            weights += [0.0] * window
            inside += [inner] * window
        if t:
            texts.append(t)
            weights.append(weight)
            inside.append(inner)
    half = window // 2
    ends = [0.0]
    for w in weights:
        ends.append(ends[-1] + w)
    n = len(weights)
    sums = [ends[min(n, k + half + 1)] - ends[max(0, k - half)] for k in range(n)]
    need = min(max(sums, default=0), LEAST)
    stretches: list[tuple[float, int, int]] = []
    k = 0
    while k < n:
        if sums[k] <= 0:
            k += 1
            continue
        dive = k
        while dive < n and sums[dive] > 0:
            dive += 1
        if max(sums[k:dive]) >= need:
            stretches.append((ends[dive] - ends[k], k, dive))
        k = dive
    most = max((x for x, _, _ in stretches), default=0)
    kept = [t for x, a, b in stretches if best is None or inside[a] or x >= share * most for t, w in zip(texts[a:b], weights[a:b], strict=True) if w]
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_arrow(chosen, run, "page_id long, url string, text string, n_chars long")

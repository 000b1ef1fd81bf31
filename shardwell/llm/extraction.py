"""Main text of HTML pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Elements that are boilerplate by their name or role, or by their class where they don't
hold the page's content, count as one tag each and their words don't count; an element ends where HTML ends it, and one that is never ended
is a tag alone.  Words score positive, tags negative; the weights are learned by a perceptron on pages that label their own
content (an ``article`` or ``main`` element), so that the best contiguous region is the labelled one.  One linear scan finds a page's
region of greatest score, and its blocks are the text.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import map_texts

#: Labelled pages that weights are learned from at most (by hash of the id), and their greatest length.
SAMPLE, SAMPLE_CHARS = 400, 200_000

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th option".split())
BOILER = frozenset("nav footer aside head menu dialog button select".split())
#: Elements whose end tag is optional: the end of what they lie in ends them too.
OPTIONAL = frozenset("p li dt dd option optgroup td th tr thead tbody tfoot colgroup caption head body html rt rp".split())
#: What ends at the start of an element of a name, unless one of the last names was opened since.
_TABLE, _LIST = ("table",), ("ul", "ol", "menu", "dir", "table", "td", "th", "section", "article", "main", "aside", "nav", "blockquote", "form", "fieldset", "details")
_ENDS = {
    "li": (("li",), _LIST),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl", *_LIST))),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    **dict.fromkeys(("td", "th"), (("td", "th"), _TABLE)),
    "tr": (("td", "th", "tr", "caption", "colgroup"), _TABLE),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), _TABLE)),
}
_ENDS_P = BLOCK - frozenset("body caption head html legend tbody tfoot thead tr".split())
_P_WITHIN = ("button", "caption", "table", "td", "th")
_IN_HEAD = frozenset("base html link meta".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_attr = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_boiler_name = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|sidebar|side|menu|nav"
    r"|navbar|navigation|breadcrumbs?|masthead|header|topbar|footer|comments?|respond|replies|disqus|share|sharing|social|related|recommend\w*|widget|login"
    r"|signup|search|pagination|pager|toolbar|copyright)(?:$|[\s_-])",
    re.I,
)
#: Names of reader comments, by their first part, so that an article that says how many it has isn't one.
_comment_name = re.compile(r"(?:^|\s)(?:div-|li-|post-)?(?:comments?(?:list|-list|-body|-content|-item|-area|-section|-wrap\w*|-thread|-\d+|s)?|commentlist|respond|replies|disqus\w*)(?:$|\s)", re.I)
#: Weights before learning; links cost more than other tags, since lists of links are navigation.
START = {"word": 1.0, "tag": -0.15, "boiler": -2.0, "tag:a": -0.8}


def is_boiler(name: str, attrs: str, inside: bool) -> str:
    """'hard' for an element that is boilerplate by its name, role or being hidden, 'soft' by its class or id or as a form, 'comment' for reader
    comments, else the empty string; ``inside``: within article or main, where a header is content."""
    if name in BOILER or (name == "header" and not inside):
        return "hard"
    soft = "soft" if name == "form" else ""
    if not attrs.strip() or name in ("html", "body", "main"):
        return soft
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", _attr.sub("", attrs)):
        return "hard"
    for k, v in _attr.findall(attrs):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id"):
            if _comment_name.search(v):
                return "comment"
            if name != "article" and not (inside and name == "header") and _boiler_name.search(v):
                soft = "soft"
        if name != "article" and ((k == "role" and v.lower() in ROLES) or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I))):
            return "soft" if v.lower() == "form" else "hard"
    return soft


def _ends(html: str, tags: list[re.Match]) -> dict[int, tuple[int, int]]:
    """Where each element ends: by the number of its start tag, (the tag to go on with, place in the page); none for one that nothing ends.

    An element ends at its own end tag, at the start of another that HTML lets end it, or, if its end tag is optional or comes later, at the
    end tag of an element around it.
    """
    found: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int]] = []
    opened: dict[str, list[int]] = {}  # places in the stack by name
    blocks: list[int] = []
    late: dict[str, list[tuple[int, tuple[int, int]]]] = {}  # ended from outside without an end tag so far

    def last(*names: str) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=-1)

    def close(k: int, end: tuple[int, int], own: tuple[int, int] | None = None) -> None:
        """End what lies from place ``k`` of the stack on; ``own``: where the element at ``k`` ends."""
        while len(stack) > k:
            name, i = stack.pop()
            opened[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if len(stack) == k and own:
                found[i] = own
            elif name in OPTIONAL:
                found[i] = end
            else:
                late.setdefault(name, []).append((i, end))

    for j, m in enumerate(tags):
        before = tags[j - 1].end() if j else 0
        if stack and stack[-1][0] == "head" and html[before : m.start()].strip():
            close(len(stack) - 1, (j, before))
        name = (m[3] or "").lower()
        if not name:
            continue
        here = (j, m.start())
        if m[2]:
            k = last(name)
            if k < 0:
                if late.get(name):
                    i, end = late[name].pop()
                    found[i] = end
            elif name in BLOCK or name in SPACE or name in BOILER or not blocks or blocks[-1] < k:  # an inline end tag ends no block
                close(k, here, (j + 1, m.end()))
            continue
        if name not in _IN_HEAD and last("head") >= 0:
            close(last("head"), here, here)
        if name in _ENDS_P and last("p") > last(*_P_WITHIN):
            close(last("p"), here, here)
        if name in _ENDS:
            ended, within = _ENDS[name]
            wall = last(*[x for x in within if x != name])
            k = min((opened[x][-1] for x in ended if opened.get(x) and opened[x][-1] > wall), default=-1)
            if k >= 0:
                close(k, here, here)
        if name not in VOID and not m[4].endswith("/"):
            if name in BLOCK:
                blocks.append(len(stack))
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, j))
    for name, i in stack:
        if name == "p":  # the page's end ends it
            found[i] = (len(tags), len(html))
    return found


def sequence(html: str, soft: bool = True) -> list[tuple[str, object]]:
    """('word', text) for stretches of text, ('tag', name or /name) and ('boiler', name) in page order.

    An element whose class or id is one of page furniture, or a form, is boilerplate only if it doesn't hold what the page is about: a main or
    article element, or (unless it is named for comments) more than half of the page's words.  With ``soft`` off such names don't count.
    """
    out: list[tuple[str, object]] = []
    tags = list(_markup.finditer(html))
    ends = _ends(html, tags)
    # words and content elements before each tag
    words, content = [0], [0]
    at = 0
    for m in tags:
        words.append(words[-1] + len(html[at : m.start()].split()))
        name = (m[3] or "").lower()
        content.append(content[-1] + (name in ("article", "main") and not m[2] and not is_boiler(name, m[4], True)))
        at = m.end()
    total = words[-1] + len(html[at:].split())

    def holds_content(i: int, end: int) -> bool:
        return content[end] > content[i + 1]

    def wraps(i: int, end: int) -> bool:
        return 2 * (words[end] - words[i + 1]) > total

    at, j, inside = 0, 0, 0
    while j < len(tags):
        m = tags[j]
        if m.start() > at:
            out.append(("word", _html.unescape(html[at : m.start()])))
        i, at, j = j, m.end(), j + 1
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            inside -= name in ("article", "main")
            out.append(("tag", "/" + name))
            continue
        kind = is_boiler(name, m[4], inside > 0) if name not in VOID else ""
        if kind in ("soft", "comment") and not soft:
            kind = ""
        if kind in ("soft", "comment") and i in ends and (holds_content(i, ends[i][0]) or (kind == "soft" and wraps(i, ends[i][0]))):
            kind = ""
        if kind:
            out.append(("boiler", name))
            if not m[4].endswith("/") and i in ends:
                j, at = ends[i]
            continue
        inside += name in ("article", "main")
        out.append(("tag", name))
    if at < len(html):
        out.append(("word", _html.unescape(html[at:])))
    return out


def key(item: tuple[str, object]) -> str:
    kind, x = item
    return "word" if kind == "word" else f"{kind}:{str(x).lstrip('/')}"


def amount(item: tuple[str, object]) -> int:
    return len(str(item[1]).split()) if item[0] == "word" else 1


def weight(weights: dict[str, float], k: str) -> float:
    return weights.get(k, START.get(k, START[k.split(":")[0]]))


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, past the last) of the contiguous stretch with the greatest sum, the earliest and shortest of equals; (0, 0) if none is above 0."""
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best + 1e-12:
            best, lo, hi = run, start, i + 1
    return lo, hi


def labelled_region(items: list[tuple[str, int]]) -> tuple[int, int] | None:
    """Of the first article or main to its last end; items: (key with the slash, amount)."""
    for name in ("main", "article"):
        lo = next((i for i, (k, _) in enumerate(items) if k == f"tag:{name}"), None)
        if lo is not None:
            hi = max((i for i, (k, _) in enumerate(items) if k == f"tag:/{name}"), default=len(items))
            if any(k == "word" and n for k, n in items[lo:hi]):
                return lo, hi + 1
    return None


def learn(pages: list[list[tuple[str, int]]], rounds: int = 5) -> dict[str, float]:
    """Averaged perceptron: move weights until the best region has the labelled region's words; words stay positive, tags negative."""
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    n = 0
    for _ in range(rounds):
        for items in pages:
            gold = labelled_region(items)
            if gold is None:
                continue
            keys = [k.replace(":/", ":") for k, _ in items]
            lo, hi = best_region([weight(w, k) * c for k, (_, c) in zip(keys, items)])
            got = {i for i in range(lo, hi) if keys[i] == "word" and items[i][1]}
            want = {i for i in range(*gold) if i < len(items) and keys[i] == "word" and items[i][1]}
            if got != want:
                size = max(1, len(items))
                for i in set(range(lo, hi)) ^ set(range(gold[0], min(gold[1], len(items)))):
                    sign = 1 if gold[0] <= i < gold[1] else -1
                    w[keys[i]] = weight(w, keys[i]) + sign * 20.0 * min(items[i][1], 20) / size
                for k in w:
                    w[k] = max(0.05, w[k]) if k == "word" else min(-0.05, w[k])
            n += 1
            for k, v in w.items():
                total[k] = total.get(k, weight({}, k) * (n - 1)) + v
    return {k: round(v / n, 6) for k, v in total.items()}


def text_of(html: str | None, weights: dict[str, float]) -> str:
    """Blocks of the page's best region, joined by empty lines; if nothing is left without the elements named for page furniture, with them."""
    return _text(sequence(html or ""), weights) or _text(sequence(html or "", soft=False), weights)


def _text(items: list[tuple[str, object]], weights: dict[str, float]) -> str:
    lo, hi = best_region([weight(weights, key(x)) * amount(x) for x in items])
    blocks: list[str] = []
    part: list[str] = []

    def close() -> None:
        block = " ".join("".join(part).split())
        if block:
            blocks.append(block)
        part.clear()

    for kind, x in items[lo:hi]:
        if kind == "word":
            part.append(str(x))
        elif kind == "boiler" or str(x).lstrip("/") in BLOCK:
            close()
        elif str(x).lstrip("/") in SPACE:
            part.append(" ")
    close()
    return "\n\n".join(blocks)


def train(pages: DataFrame, most: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from at most ``most`` pages of at most ``SAMPLE_CHARS`` characters that label their content; none give the starting weights."""
    html = F.col(html_col)
    sample = pages.filter(html.rlike("(?i)<(article|main)[\\s>]") & (F.length(html) <= SAMPLE_CHARS))
    sample = sample.select(F.col(id_col).alias("_id"), html.alias("_html")).orderBy(F.xxhash64("_id"), F.xxhash64("_html")).limit(most)

    def setup():
        def make(texts):
            rows = [[(f"{k}:{x}" if k != "word" else k, amount((k, x))) for k, x in sequence(t)] for t in texts]
            return list(range(len(rows))), [[[{"k": k, "n": n} for k, n in r] for r in rows]]

        return make

    got = map_texts(sample, [F.col("_id")], F.col("_html"), setup, "items array<struct<k:string,n:int>>").collect()  # `most` pages
    return learn([[(i["k"], i["n"]) for i in r["items"]] for r in sorted(got, key=lambda r: str(r["_id"]))])


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url, text, n_chars.

    Null or empty html, or no region that scores above 0: the empty text.  Null ids and urls are kept; repeated rows: each is extracted;
    equal regions: the earliest.  Empty table: no rows.  Broken markup is read as far as it goes; whole pages are read, in time linear in
    their length.  Other columns are ignored, whatever their names.
    """
    w = train(pages, id_col=id_col, html_col=html_col) if weights is None else weights

    def setup():
        def make(texts):
            out = [text_of(t, w) for t in texts]
            return list(range(len(out))), [out, [len(t) for t in out]]

        return make

    keep = [F.col(id_col).alias("_id"), F.col(url_col).alias("_url")]
    out = map_texts(pages, keep, F.col(html_col).alias("_html"), setup, "text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")

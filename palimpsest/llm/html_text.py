"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks.  A logistic classifier over each block's
markup and text gives it a cost for either label; these are the capacities from
the source (content) and to the sink (boilerplate).  Neighbouring blocks, and
consecutive blocks of one container, are joined by smoothness edges.  The maximum
flow's cut is the labelling of least total cost, and the content side is the text.

The classifier is trained on a small labelled table of pages made by rule.  Pages
are independent: one pass, no shuffle.

Defined results: a null or empty page has an empty text; pages of any length are
read whole; broken markup is read as far as it goes (an unfinished tag at the end
is dropped; an element without its end tag hides nothing, but for those whose text
is raw, such as script); repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._words import chunks

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?=[\s/=]|$)(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_VALUES = re.compile(r"""(\b(?!style\b|aria-hidden\b|hidden\b)[\w:-]+\s*=\s*)(?:"[^"]*"|'[^']*')""", re.I)  # other attributes' values hide nothing
_PARTS = re.compile(r"[a-z]+|[0-9]+")

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg object textarea select button title head canvas audio video".split())
_TO_END = frozenset("script style textarea title iframe".split())  # without an end tag these run to the end of the page
_CLOSE = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
#: Elements that break a line of text.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = BLOCK - frozenset("br hr p h1 h2 h3 h4 h5 h6".split())
_SAME = frozenset("li td th tr dt dd option".split())  # a new one closes an open one
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

NAV, HEADER, FOOTER, ASIDE, FORM, ARTICLE, COMMENT, ADVERT, NOTICE, GOOD, BAD, HIDDEN = (1 << k for k in range(12))
_BY_TAG = {"nav": NAV, "menu": NAV, "header": HEADER, "footer": FOOTER, "aside": ASIDE, "form": FORM, "fieldset": FORM, "dialog": NOTICE, "article": ARTICLE, "main": ARTICLE}
_BY_WORD = {
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs skip".split(), NAV),
    **dict.fromkeys("header masthead topbar banner logo".split(), HEADER),
    **dict.fromkeys("footer foot copyright colophon legal".split(), FOOTER),
    **dict.fromkeys("sidebar aside rail widget widgets complementary".split(), ASIDE),
    **dict.fromkeys("form login signin signup search subscribe subscription newsletter register contact".split(), FORM),
    **dict.fromkeys("comment comments reply replies respond disqus discussion reviews".split(), COMMENT),
    **dict.fromkeys("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion dfp outbrain taboola".split(), ADVERT),
    **dict.fromkeys("cookie cookies consent gdpr notice alert popup modal overlay paywall warning".split(), NOTICE),
    **dict.fromkeys("article content contents main post entry story body text prose page".split(), GOOD),
    **dict.fromkeys("share sharing social related recommended trending popular more tags meta byline toolbar follow links latest".split(), BAD),
}
_INNER = COMMENT | ADVERT | NOTICE | NAV | ASIDE | FORM | BAD | FOOTER | HEADER  # an inner article ends none of these


def _flags(tag: str, attributes: str) -> int:
    out = _BY_TAG.get(tag, 0)
    if "=" in attributes:
        low = attributes.lower()
        if "class" in low or "id" in low or "role" in low or "aria" in low:
            for m in _NAMES.finditer(low):
                for w in _PARTS.findall(m[1] or m[2] or m[3] or ""):
                    out |= _BY_WORD.get(w, 0)
    if ("hidden" in attributes.lower() or "none" in attributes.lower()) and _HIDDEN.search(_VALUES.sub(r"\1''", attributes)):
        out |= HIDDEN
    return out


Block = tuple[str, int, str, int, int]  # text, flags, innermost block tag, characters in links, container


def blocks(html: str) -> list[Block]:
    """The page's text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    unclosed: set[str] = set()
    tag_now, linked, link, containers, at, end = "", 0, 0, 0, 0, len(html)

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append((text, stack[-1][1], tag_now, min(linked, len(text)), stack[-1][2]))
            pieces.clear()
        linked = 0

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            pieces.append(html[at:stop])
            if link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if tag in ("button", "select", "textarea", "title", "head"):
                close()
            if tag == "head":  # ends at its end tag or where the body begins
                stop = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(html, at)
                if stop:
                    at = stop.start() if stop[0][1] != "/" else stop.end()
            elif tag not in unclosed and not (tag == "svg" and attributes.endswith("/")):
                stop = _CLOSE[tag].search(html, at)
                if stop:
                    at = stop.end()
                elif tag in _TO_END:
                    at = end
                else:
                    unclosed.add(tag)  # what follows is read on
            continue
        if tag in BLOCK:
            close()
            tag_now = "" if closing else tag
        if tag == "a":
            link = 0 if closing else 1
        if closing:
            if opened.get(tag, 0):
                while True:
                    t, _, _ = stack.pop()
                    opened[t] -= 1
                    if t == tag:
                        break
        elif tag not in _VOID:
            flags = _flags(tag, attributes)
            if tag in CONTAINER or flags:
                if tag in _SAME and stack[-1][0] == tag:
                    stack.pop()
                    opened[tag] -= 1
                if flags and tag not in BLOCK and pieces:
                    close()
                up = stack[-1]
                containers += 1
                own = up[1] | flags
                if flags & ARTICLE and not up[1] & ARTICLE:
                    own = flags | up[1] & _INNER
                stack.append((tag, own, containers if tag not in _SAME else up[2]))
                opened[tag] = opened.get(tag, 0) + 1
    close()
    return out


NAMED, PLAIN = 27, 36
FEATURES = NAMED + PLAIN


def features(row: list[Block]) -> np.ndarray:
    """A page where some element says by tag or name that it holds the content is judged by that; of the others,
    where the text lies dense, how much of it is links, and what stands around it."""
    x = np.zeros((len(row), FEATURES))
    if not any(b[1] & (ARTICLE | GOOD) for b in row):
        x[:, NAMED:] = _plain(row)
        return x
    for i, (text, flags, tag, linked, _) in enumerate(row):
        n = len(text)
        words = text.count(" ") + 1
        x[i, :12] = [(flags >> k) & 1 for k in range(12)]
        x[i, 12:NAMED] = [
            1, linked / n, min(n, 400) / 400, text[-1] in ".!?。…\"'»”", tag[:1] == "h" and len(tag) == 2, tag == "li", tag == "p", words < 4, "©" in text or "(c)" in text[:8],
            tag == "h1", n > 80, bool(flags & ARTICLE) and not flags & _INNER, flags & (ARTICLE | GOOD) == 0, bool(flags & ARTICLE and flags & HEADER and tag[:1] == "h"), tag == "",
        ]
    return x


def _plain(row: list[Block]) -> np.ndarray:
    n = np.array([len(b[0]) for b in row], float)
    linked = np.array([b[3] for b in row]) / n
    size, free = np.minimum(n, 400) / 400, n * (1 - linked)
    _, group = np.unique([b[4] for b in row], return_inverse=True)
    chars, own = np.bincount(group, n), np.bincount(group, free)
    share, dense = own[group] / max(own.sum(), 1), own[group] / chars[group]
    best = own[group] == own.max()
    ends = np.array([b[0][-1] in ".!?。…\"'»”" for b in row], float)
    prose = (n > 60) & (linked < 0.3) & (ends > 0)
    near = lambda v: np.convolve(v, [1, 1, 0, 1, 1], "same")[: len(v)] if len(v) >= 5 else np.array([np.delete(v, i).sum() for i in range(len(v))])
    tags = [b[2] for b in row]
    head = np.array([t[:1] == "h" and len(t) == 2 and t != "hr" for t in tags], float)
    after = np.append(prose[1:], False) | np.append(prose[2:], [False] * min(2, len(row)))[: len(row)]
    place = np.arange(len(row)) / max(len(row) - 1, 1)
    first = int(np.argmax(prose)) if prose.any() else len(row)
    last = len(row) - 1 - int(np.argmax(prose[::-1])) if prose.any() else -1
    at = np.arange(len(row))
    words = np.array([b[0].count(" ") + 1 for b in row])
    columns = [
        np.ones(len(row)), linked, size, ends, head, [t == "h1" for t in tags], [t == "li" for t in tags], [t == "p" for t in tags], [t in ("td", "th") for t in tags],
        words < 4, ["©" in b[0] or "(c)" in b[0][:8].lower() for b in row], n > 80, near(linked) / 4, near(size) / 4, share, dense, best, head * after, prose,
        place, place > 0.9, at < first, at > last, np.array([t == "h1" for t in tags]) * (at < first), best * (linked < 0.3), (at >= first) & (at <= last) & (linked < 0.3),
        *([(b[1] >> k) & 1 for b in row] for k in (0, 1, 2, 3, 4, 6, 7, 8, 10)), np.array([t in ("td", "th") for t in tags]) * (at >= first) * (linked < 0.3),
    ]
    return np.stack([np.asarray(c, float) for c in columns], 1)


def max_flow(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a least cut; edges hold both ways."""
    n = len(source)
    adjacent: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        adjacent[a].append(len(to))
        to.append(b)
        adjacent[b].append(len(to))
        to.append(a)
        room += [c, c]
    extra = [s - t for s, t in zip(source, sink)]  # what a node can still take from the source, or give to the sink
    eps = 1e-9
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if extra[v] > eps]
        for v in queue:
            level[v] = 0
        reached = False
        for v in queue:
            if extra[v] < -eps:
                reached = True
            for e in adjacent[v]:
                if room[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in [v for v in range(n) if level[v] == 0]:
            path: list[int] = []
            v = s
            while extra[s] > eps:
                if extra[v] < -eps and path:
                    push = min(extra[s], -extra[v], *(room[e] for e in path)) if path else 0
                    extra[s] -= push
                    extra[v] += push
                    back = len(path)
                    for k, e in enumerate(path):
                        room[e] -= push
                        room[e ^ 1] += push
                        if room[e] <= eps and k < back:
                            back = k
                    v = s if back == 0 else to[path[back - 1]]
                    del path[back:]
                    continue
                own = adjacent[v]
                while arc[v] < len(own) and not (room[own[arc[v]]] > eps and level[to[own[arc[v]]]] == level[v] + 1):
                    arc[v] += 1
                if arc[v] < len(own):
                    path.append(own[arc[v]])
                    v = to[own[arc[v]]]
                elif path:
                    e = path.pop()
                    v = to[e ^ 1]
                    arc[v] += 1
                else:
                    break


NEAR, SAME = 0.6, 0.5  # smoothness of neighbours, and of consecutive blocks of one container


def label(row: list[Block], weight: np.ndarray) -> list[bool]:
    """True for content.  Hidden blocks are none, and say nothing of the others."""
    seen = [b for b in row if not b[1] & HIDDEN]
    if len(seen) < len(row):
        kept = iter(label(seen, weight))
        return [not b[1] & HIDDEN and next(kept) for b in row]
    if not row:
        return []
    z = np.clip(features(row) @ weight, -12, 12)
    source, sink = np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist()  # costs of boilerplate, of content
    edges, last = [], {}
    for i, b in enumerate(row):
        if i:
            edges.append((i - 1, i, NEAR if b[4] == row[i - 1][4] else NEAR / 4))
        if b[4] in last and last[b[4]] != i - 1:
            edges.append((last[b[4]], i, SAME))
        last[b[4]] = i
    return max_flow(source, sink, edges)


def extract(html: str | None, weight: np.ndarray) -> str:
    row = blocks(html) if html else []
    return "\n".join(b[0] for b, keep in zip(row, label(row, weight)) if keep)


def train(rows: list[tuple[str, str]], rounds: int = 40, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps on (html, text) rows: a block is content if
    it is a line of the text."""
    xs, ys = [], []
    for html, text in rows:
        row, lines = [b for b in blocks(html) if not b[1] & HIDDEN], set(text.split("\n"))
        xs.append(features(row))
        ys += [b[0] in lines for b in row]
    x, y = np.concatenate(xs) if xs else np.zeros((0, FEATURES)), np.array(ys, float)
    w = np.zeros(FEATURES)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty / 10 * np.eye(FEATURES)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def labelled_pages(n: int = 300, seed: int = 5) -> list[tuple[str, str]]:
    """A small labelled table made by rule: (html, text) of pages of invented words."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    word = lambda: "".join(rng.choice(list("aeioubdklmnrstv"), int(rng.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    line = lambda a=3, b=60: words(a, b).capitalize() + pick(".", ".", ".", "!", "?", "", "!!")
    item = lambda: f'<li><a href="/{word()}">{words(1, 4)}</a></li>'
    menu = lambda: "<ul>" + "".join(item() for _ in range(int(rng.integers(2, 8)))) + "</ul>"
    out = []
    for _ in range(n):
        title = line(2, 9)
        body = [line(*pick((1, 4), (4, 20), (15, 90))) for _ in range(int(rng.integers(1, 9)))]
        inner = "".join(pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br>", f"<div>{t}</div>", f"<ul><li>{t}</li></ul>", f"<blockquote>{t}</blockquote>") for t in body)
        junk = lambda: pick(
            "", f'<div class="{pick("ad", "ads", "advert", "sponsored")}">{line()}</div>', f'<aside>{menu()}<p>{line()}</p></aside>',
            f'<div class="sidebar"><h3>{words(1, 4)}</h3>{menu()}</div>', f'<div class="{pick("cookie-notice", "consent", "notice")}"><p>{line()}</p></div>',
            f"<form><label>{words(1, 4)}</label><p>{line(3, 12)}</p></form>", f'<div class="newsletter">{line(3, 14)}</div>', f'<div class="related"><h4>{words(1, 3)}</h4>{menu()}</div>',
            f'<div class="breadcrumbs"><a href="/">{word()}</a> &gt; <a href="/x">{word()}</a></div>',
        )
        comments = pick("", "", f'<section class="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{line()}</p></div>' for _ in range(3)) + "</section>")
        head = pick(f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>")
        inside, after = (comments, "") if rng.random() < 0.4 else ("", comments)
        article = pick(f"<article>{head}{inner}{inside}</article>", f"<article>{head}{inner}{inside}</article>", f"<main>{head}{inner}{inside}</main>", f'<main><article>{head}{inner}{inside}</article></main>', f'<div class="content">{head}{inner}{inside}</div>', f'<div id="post">{head}{inner}{inside}</div>')
        top = pick("", f"<header><p>{words(1, 4)}</p><nav>{menu()}</nav></header>", f"<nav>{menu()}</nav>", f'<div class="header"><p>{line(2, 8)}</p></div><nav>{menu()}</nav>')
        foot = pick(f"<footer>&copy; {word()}.com &middot; {line()}\n{line()}</footer>", f'<div class="footer"><p>&copy; {words(1, 5)}</p>{menu()}</div>', f"<footer><p>{line()}</p>{menu()}</footer>")
        html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{top}{junk()}{junk()}{article}{after}{junk()}{foot}</body></html>"
        out.append((html, "\n".join([title, *body])))
    return out


def plain_pages(n: int = 200, seed: int = 6) -> list[tuple[str, str]]:
    """As labelled_pages, of pages whose elements have no telling names: (html, text)."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    many = lambda f, a, b: "".join(f() for _ in range(int(rng.integers(a, b))))
    word = lambda: "".join(rng.choice(list("aeioubdklmnrstv"), int(rng.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    line = lambda a=6, b=70: words(a, b).capitalize() + pick(".", ".", ".", "!", "?")
    name = lambda: pick("", "", f' class="{word()}"', f' class="{pick("wrap", "row", "col", "box", "c", "left", "right", "inner", "grid")}{int(rng.integers(1, 13))}"', f' id="{word()}"')
    link = lambda: f'<a href="/{word()}">{words(1, 6).capitalize()}</a>'
    out = []
    for _ in range(n):
        lines = []

        def say(text: str) -> str:
            lines.append(text)
            return text

        def part() -> str:
            kind = int(rng.integers(9))
            if kind < 4:
                return f"<p>{say(line())}</p>"
            if kind == 4:
                return f"<div{name()}>{say(line(12))}</div>"
            if kind == 5:
                return f"{say(line(12))}<br><br>"
            if kind == 6:
                return "<ul>" + many(lambda: f"<li>{say(line(3, 16))}</li>", 2, 5) + "</ul>"
            if kind == 7:
                return "<table>" + many(lambda: f"<tr><td>{say(words(1, 4))}</td><td>{say(words(1, 3))}</td></tr>", 2, 5) + "</table>"
            return f"<h{pick(2, 3)}>{say(words(1, 6).capitalize())}</h{2}><p>{say(line())}</p>"

        bar = lambda: pick(f"<div{name()}>" + " | ".join(link() for _ in range(int(rng.integers(3, 8)))) + "</div>", f"<ul{name()}>" + many(lambda: f"<li>{link()}</li>", 3, 9) + "</ul>", "<table><tr>" + many(lambda: f"<td>{link()}</td>", 3, 7) + "</tr></table>")
        side = lambda: f"<div{name()}>" + pick(f"<h3>{words(1, 4)}</h3>", f"<b>{words(1, 3)}</b>") + many(lambda: pick(f"<div>{link()}</div>", f"<p>{link()}</p>", f"<li>{link()}</li>"), 2, 7) + "</div>"
        logo = pick("", f"<div{name()}>{words(1, 3).capitalize()}</div>", f"<div{name()}><a href='/'>{word()}</a></div>")
        title = words(2, 10).capitalize()
        heading = pick(f"<h1>{say(title)}</h1>", f"<h2>{say(title)}</h2>" if not lines else "")
        body = heading + f"<p>{say(line(15))}</p>" + many(part, 1, 7) + f"<p>{say(line(12))}</p>"
        foot = f"<div{name()}>" + pick(f"&copy; {int(rng.integers(1995, 2026))} {words(1, 5)}", f"{link()} {link()} {link()}", f"&copy; {words(1, 3)}. {words(2, 5)} {link()}") + "</div>"
        main, beside = f"<div{name()}>{body}</div>", pick("", side(), side() + side())
        middle = pick(f"<div{name()}>{main}{beside}</div>", f"<div{name()}>{beside}{main}</div>", f"<table><tr><td>{beside}</td><td>{body}</td></tr></table>", f"{main}{beside}")
        out.append((f"<html><head><title>{title}</title></head><body>{logo}{bar()}{middle}{pick('', bar())}{foot}</body></html>", "\n".join(lines)))
    return out


def labelled_table(spark: SparkSession, n: int = 300) -> DataFrame:
    return spark.createDataFrame(labelled_pages(n) + plain_pages(n), "html string, text string")


def weights_of(labelled: DataFrame, max_rows: int = 5000) -> np.ndarray:
    """Train on the labelled table, at most ``max_rows`` of it."""
    return train([(r["html"], r["text"]) for r in labelled.where("html is not null and text is not null").orderBy("html").limit(max_rows).collect()])


def main_text(pages: DataFrame, weight: np.ndarray, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_name: str = "text") -> DataFrame:
    """The kept columns and the page's main text, one row per input row."""
    kept = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__html", 4 << 20):
                text = [extract(h, weight) for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text, pa.string())], names=[*keep, text_name])

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{fields}, `{text_name}` string")

"""Problem 1: the main body of web pages.

Method: composite text density. Every DOM node gets a link-adjusted number of characters per tag; the densities of a
node's children are summed; the node of the largest sum is the main subtree, and of its parts that hold links those
are kept whose density reaches the least density on the path from the subtree up to the body. What such a subtree
still embeds of notices, sharing bars, boxes and comments is told by its role in the markup, its share of link text
and the phrases such boxes are headed with.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, spread

# Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object select canvas noframes title xmp".split())
SIDE = frozenset("nav aside footer button form menu dialog head option".split())
#: Elements that are parts of a body and not one themselves.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote table tbody tr thead tfoot".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tr td th thead tbody", ("table",)), "tfoot": ("tr td th thead tbody", ("table",))}
_PHRASING_SCOPE = frozenset("table td th ul ol div section article main body blockquote".split())

# Phrases that head or make up boxes beside an article.
_CUES = (
    r"cookies?\b|\bconsent\b|your privacy|privacy (?:policy|matters|settings)|datenschutz\w*|confidentialit[ée]|privacidad|files on your device|accept all|manage (?:your )?choices",
    r"advert(?:isement|ising|orial)?s?\b|sponsored?\b|promot(?:ed|ion)\b|anzeige\b|werbung\b|publicité\b|publicidad\b|pubblicità\b|publicidade\b|special offer|\d+ ?% off|only \d+ (?:coins|euros?|dollars|pounds)|buy now|order now",
    r"related (?:pages|articles|posts|stories|links|content)|you (?:may|might) (?:also )?like|(?:read|up) next|read more|most (?:read|popular|viewed|shared)|more (?:from|on this|stories)|recommended(?: for you)?|trending|popular (?:posts|pages)|see also|in this section|latest (?:news|posts)|lesen sie auch|à lire aussi|lea también|leggi anche|lees ook",
    r"about the (?:author|writer|editor|site)|about (?:this site|us)|who we are|written by|über (?:uns|den autor|die autorin)|à propos de (?:l'auteur|nous)|sobre (?:el autor|nosotros|o autor|nós)|chi siamo|over (?:ons|de auteur)",
    r"sign up|subscribe\w*|newsletter|weekly letter|never miss|enter your (?:address|e-?mail)|one mail a|support our work|become a member|donate|abonnieren|abonnez-vous|suscr[ií]b\w+|iscriviti",
    r"share (?:this|on)|\d+ shares?\b|\bshare\b|copy (?:the )?link|e-?mail (?:a|to a|this to a) friend|report a problem|save for later|listen to this page|\bprint(?: (?:this )?page)?\b|\blikes?\b|tweet|follow us|teilen|drucken|partager|imprimer|compartir|condividi",
    r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|tutti i diritti|todos os direitos|©|\(c\) ?\d{4}|copyright|terms of use|imprint\b|impressum|powered by|made with|page served|generated in|last changed|last modified|back to top|skip to (?:content|main)|rss feed|registered charity|no part may be copied",
    r"\breply\b|(?:loading|leave a|post a|no) comments?|\d+ comments?\b|antworten\b|répondre\b|responder\b|rispondi\b|permalink|bookmarked",
    r"(?:please |you must )?(?:log ?in|sign in|register) to|page not found|not found|\b404\b|\b403\b|\b50[0-9]\b|this page has moved|checking your browser|turn on (?:scripting|javascript)|enable javascript|access denied|try again later|subscribers only|seite nicht gefunden|page introuvable",
    r"\b(?:home|login|log in|register|search|contact|settings|ok|got it|akzeptieren|accepter|aceptar|menu)\b",
)
# They are matched in lower-case texts: without case to ignore, a branch is ruled out by its first letter.
CUE = re.compile("|".join(_CUES))
_SMALL_CUE = re.compile(_CUES[7])
_NOTICE_CUE = re.compile(_CUES[0] + "|" + _CUES[4])
HEAD_CUE = re.compile("|".join(_CUES[:5]) + "|" + _CUES[6] + "|comments?\\b|" + _CUES[8])
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FLOAT = re.compile(r"float\s*:\s*(?:left|right)|position\s*:\s*(?:fixed|sticky)", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_WS = re.compile(r"\s+")
_OTHER = re.compile(r"[\W\d_]+")


#: Elements nested deeper stay closed and their content goes to the element at this depth, as in browsers.
DEPTH = 512


class Node:
    __slots__ = ("tag", "kids", "parent", "side", "floats", "own", "link", "c", "t", "lc", "lt", "density", "sum", "cut", "depth")

    def __init__(self, tag: str, parent: Node | None, side: bool = False, floats: bool = False):
        self.tag, self.parent, self.side, self.floats, self.cut = tag, parent, side, floats, False
        self.kids: list[Node | str] = []
        self.depth = parent.depth + 1 if parent is not None else 0
        self.link = parent is not None and (parent.link or tag == "a")
        self.own = self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0


def decode(payload: bytes, content_type: str | None = None) -> str:
    """Bytes to text: a byte-order mark, else valid UTF-8 (but for a cut-off end), else the declared charset, else
    windows-1252. As in browsers a charset is looked for in the first 4096 bytes; all bytes are decoded."""
    for bom, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if payload.startswith(bom):
            return payload.decode(codec, "replace")
    m = _CHARSET.search((content_type or "").encode()) or _CHARSET.search(payload[:4096])
    name = m[1].decode("ascii", "ignore").lower() if m else "windows-1252"
    for cut in range(4 if len(payload) > 4 and (not m or name.startswith("utf")) else 1):
        try:
            return payload[: len(payload) - cut].decode("utf-8")
        except UnicodeDecodeError as e:
            if e.start < len(payload) - 4:
                break
    if name in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii", "utf-8", "utf8"):
        name = "windows-1252"
    try:
        return payload.decode(name, "replace")
    except LookupError:
        return payload.decode("windows-1252", "replace")


def parse(page: str) -> Node:
    """A forgiving DOM: implied end tags, unclosed elements, raw-text elements skipped, stray end tags ignored."""
    root = Node("#root", None)
    at, pos, low = root, 0, page.lower()
    for m in iter(lambda: _TAG.search(page, pos), None):
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up.parent is not None and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    break
                up = up.parent
            if up.tag == tag and up.parent is not None:
                at = up.parent
            elif tag == "p":
                at.kids.append(Node("p", at))
            continue
        if tag in RAW:
            end = low.find("</" + tag, pos)
            at.kids.append(Node("#raw", at))
            if end < 0:
                if tag == "title":
                    continue
                pos = len(page)
                break
            close = page.find(">", end)
            pos = len(page) if close < 0 else close + 1
            continue
        if tag in _CLOSES_P:
            up = at
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in _IMPLIED:
            shut, stop = _IMPLIED[tag]
            up, found = at, None
            while up is not None and up.tag not in stop:
                if up.tag in shut.split():
                    found = up
                up = up.parent
            if found is not None:
                at = found.parent
        if tag == "body" or tag == "html":
            b = at
            while b.parent is not None:
                b = b.parent
            if any(isinstance(k, Node) and k.tag == tag for k in b.kids):
                continue
            if at.tag == "head":
                at = at.parent
        attrs = m[3]
        node = Node(tag, at, tag in SIDE or bool(attrs and _HIDDEN.search(attrs)), bool(attrs and _FLOAT.search(attrs)))
        at.kids.append(node)
        if tag not in VOID and not attrs.endswith("/") and node.depth < DEPTH:
            at = node
    if pos < len(page):
        at.kids.append(page[pos:])
    return root


def _plain(raw: str) -> str:
    return _WS.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()


def below(node: Node) -> list[Node]:
    """A node and all nodes under it, each before its children; without what was cut."""
    out = [node]
    for n in out:
        out += [k for k in n.kids if not isinstance(k, str) and not k.cut]
    return out


def walk(node: Node, enter) -> Iterator[str | bool]:
    """The strings under a node in order, and False wherever a block-level element begins or ends. enter: whether the
    content of an element is to be seen."""
    stack: list[Iterator] = [iter(node.kids)]
    ends: list[bool] = [False]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            if ends.pop():
                yield False
        elif isinstance(k, str):
            yield k
        else:
            block = k.tag not in INLINE
            if block:
                yield False
            if enter(k):
                stack.append(iter(k.kids))
                ends.append(block)
            elif block:
                yield False


def text_of(node: Node) -> str:
    return _plain("".join(x or " " for x in walk(node, lambda k: not k.cut)))


def measure(nodes: list[Node], first: bool = False) -> None:
    """Characters, tags, and those of them in links, of every node, without what was cut; children come after parents.
    first: also the characters of each node's own strings, which do not change."""
    for n in nodes:
        if first:
            n.own = sum(len(_plain(k)) for k in n.kids if isinstance(k, str))
        n.c, n.t, n.lc, n.lt = n.own, 0, n.own if n.link else 0, 0
    for n in reversed(nodes):
        up = n.parent
        if up is not None and not n.cut:
            up.c, up.t, up.lc, up.lt = up.c + n.c, up.t + n.t + 1, up.lc + n.lc, up.lt + n.lt + n.link


def densities(nodes: list[Node], body: Node) -> None:
    """Composite density of every node and the sum of its children's densities."""
    for n in nodes:
        c, t, lc, lt = n.c, max(n.t, 1), n.lc, n.lt
        if c:
            base = c / max(c - lc, 1) * lc + body.lc / max(body.c, 1) * c + math.e
            n.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1e-9), max(math.log(base), 1.0001)) if lc else c / t
        else:
            n.density = 0.0
        n.sum = float(sum(len(x) for k in n.kids if isinstance(k, str) and len(x := k.strip()) > 20))
    for n in nodes[1:]:
        n.parent.sum += max(n.density, 0.0)


@lru_cache(maxsize=1 << 16)
def _left_over(text: str) -> float:
    """Share of a text's letters that no cue phrase covers. Boxes recur from page to page, so that results are kept."""
    letters = len(_OTHER.sub("", text))
    return len(_OTHER.sub("", CUE.sub(" ", text.lower()))) / letters if letters else 0.0


@lru_cache(maxsize=1 << 16)
def _heads(text: str) -> int:
    """How many phrases that head boxes a text holds."""
    return len(HEAD_CUE.findall(text.lower()))


def _is_box(node: Node, whole: int) -> bool:
    """A block that stands beside the article: its head is a cue, or cues make up most of it, or links do."""
    if not node.c:
        return True
    if node.c > 0.6 * whole and node.c > 400:
        return False
    head = next((k for k in node.kids if isinstance(k, Node) and k.tag[0] == "h" and k.tag[1:].isdigit()), None)
    if head is not None and head.c < 100 and (h := text_of(head)) and len(h) < 100 and _heads(h):
        return True
    if any(isinstance(k, Node) and k.tag in ("small", "button", "a", "span") and k.c < 100 and _SMALL_CUE.fullmatch(text_of(k).strip(" .!").lower()) for k in node.kids):
        return True
    # No rule below holds for longer texts, and a text has at least the characters of its parts.
    if node.c < 220 and node.tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "section", "center", "header", "span"):
        text = text_of(node)
        if len(text) < 200 and _left_over(text) < 0.45:
            return True
        if len(text) < 120 and (m := CUE.match(text.lower())) and (len(m[0]) > 5 or node.floats):
            return True
        if node.floats and len(text) < 160:
            return True
        if len(text) < 220 and _heads(text) >= 2:
            return True
        if len(text) < 160 and _NOTICE_CUE.search(text.lower()):
            return True
    return False


def _links(node: Node) -> bool:
    """Mostly link text, in more than one link or outside a paragraph."""
    return node.c > 0 and node.lc > 0.55 * node.c and (node.lt > 2 or node.tag != "p") and node.c - node.lc < 160


def prune(body: Node, whole: int) -> None:
    stack = [body]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str) or k.tag in INLINE or k.tag in VOID:
                continue
            if k.side or k.tag == "#raw" or k.tag not in ("html", "body", "table", "tr", "tbody") and (_links(k) or _is_box(k, whole)):
                k.cut = True
            else:
                stack.append(k)


def emit(node: Node, threshold: float) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []
    inside = lambda k: not k.cut and (k.tag in INLINE or not (k.lc and k.density < threshold and k.lc > 0.4 * k.c))
    for x in [*walk(node, inside), False]:
        if x is not False:
            run.append(x)
        elif run:
            if t := _plain("".join(run)):
                blocks.append(t)
            run.clear()
    return blocks


def main_body(page: str) -> list[str]:
    """The text blocks of the main body, in order; none where the page has no article."""
    root = parse(page)
    body = root
    for k in (n for n in root.kids if isinstance(n, Node)):
        if k.tag == "html":
            body = next((b for b in k.kids if isinstance(b, Node) and b.tag == "body"), k)
        elif k.tag == "body":
            body = k
    nodes = below(body)
    body.link, up = False, body.parent
    body.parent = None
    measure(nodes, first=True)
    prune(body, body.c - body.lc)
    nodes = below(body)
    measure(nodes)
    if not body.c:
        return []
    densities(nodes, body)
    body.parent = up
    best, stack = body, [body]
    while stack:
        n = stack.pop()
        if n.sum > best.sum and n.tag not in PARTS:
            best = n
        stack += [k for k in n.kids if isinstance(k, Node) and not k.cut and k.tag not in INLINE]
    threshold, up = best.density, best
    while up is not None and up is not body.parent:
        threshold, up = min(threshold, up.density), up.parent
    blocks = emit(best, threshold)
    blocks = [b for b in blocks if not (len(b) < 120 and _left_over(b) < 0.45 and _OTHER.sub("", b)) and re.search(r"\w", b)]
    if not any(len(re.findall(r"[^\W\d_]+", b)) >= 8 or (len(re.findall(r"[^\W\d_]+", b)) >= 5 and re.search(r"[.!?…]$", b)) for b in blocks):
        return []
    return blocks


def _run(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"record_id": [], "pos": [], "block": [], "block_md5": []}
    for rid, payload, ctype in zip(cols["record_id"], cols["payload"], cols["ctype"]):
        for i, b in enumerate(main_body(decode(payload, ctype))):
            out["record_id"].append(rid)
            out["pos"].append(i)
            out["block"].append(b)
            out["block_md5"].append(hashlib.md5(b.encode("utf-8", "surrogatepass")).hexdigest())
    return out


def main_body_blocks(df: DataFrame, id_col: str = "record_id", payload_col: str = "payload", type_col: str = "warc_type", headers_col: str = "headers", spread_rows: bool = True) -> DataFrame:
    """One row (record_id, pos, block, block_md5) per block of the main body of each `response` record.

    Null ids, types and payloads, empty payloads and pages without an article give no rows; repeated records give
    repeated rows; extra columns are ignored; an empty table gives no rows. Narrow: one pass, no shuffle.
    """
    ctype = F.try_element_at(F.map_from_entries(F.transform(F.map_entries(headers_col), lambda e: F.struct(F.lower(e["key"]), e["value"]))), F.lit("content-type"))
    base = df.filter((F.col(type_col) == "response") & F.col(payload_col).isNotNull() & F.col(id_col).isNotNull())
    base = base.select(F.col(id_col).alias("record_id"), F.col(payload_col).alias("payload"), ctype.alias("ctype"))
    return map_arrow(spread(base) if spread_rows else base, _run, "record_id bigint, pos int, block string, block_md5 string")

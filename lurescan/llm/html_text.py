"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features of
its ancestors (tags, class and id words) and of its text; the field is trained in numpy on labelled
pages and decoded by Viterbi.
"""

from __future__ import annotations

import html
import io
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.text import map_slices, once

# Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN_TAGS = frozenset(
    "annotation annotation-xml applet canvas datalist embed iframe noembed noframes noscript object script style svg "
    "template textarea title".split()
)
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title".split())
#: Start tags that end an open svg.
BREAKOUT_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: An open element of the first kind ends when one of the second kind begins inside the same holder.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """Text of a leaf block, its own tag and all tags above it, their class and id words, and the characters in links."""

    __slots__ = ("text", "own", "tags", "names", "linked", "holder")

    def __init__(self, text, own, tags, names, linked, holder):
        self.text, self.own, self.tags, self.names, self.linked, self.holder = text, own, tags, names, linked, holder


def blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order; character references decoded, white space folded, empty ones left out.

    A head hides nothing but its elements that are not shown, so its end tag may be missing. An element
    that is not shown ends at its end tag or where its holder is closed, an svg also at a tag that cannot
    stand in one; where no end tag follows at all, its content is text of the page.

    An open element shares the sets of tags and words with the one it stands in, unless it adds to them.
    ``known`` bounds the words that count, so that deep pages take linear time and space.
    """
    found: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset, int]] = []  # tag, tags and words down to it, number
    standing: Counter = Counter()  # open elements by tag
    parts: list[str] = []
    state = {"linked": 0, "link": False, "unseen": None, "serial": 0}
    inner: list[str] = []
    opened: Counter = Counter()
    ends: dict[str, int] = {}

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own, tags, names, _ = stack[-1] if stack else ("none", frozenset(), frozenset(), 0)
                holder = stack[-2][3] if len(stack) > 1 else 0
                found.append(Block(text, own, tags, names, state["linked"], holder))
            parts.clear()
        state["linked"] = 0

    def said(raw: str):
        if raw and state["unseen"] is None:
            text = html.unescape(raw)
            parts.append(text)
            if state["link"]:
                state["linked"] += len("".join(text.split()))

    def close(names: set, holders: set):
        if not any(standing[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                standing.subtract(t for t, *_ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in holders:
                return

    def ended_later(tag: str) -> bool:
        if tag not in ends:
            ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}(?=[\s/>])", page, re.IGNORECASE)), default=-1)
        return ends[tag] >= at

    def leaves(tag: str, closing: bool) -> bool:
        """Whether a tag inside an unseen element ends that element."""
        if not closing:
            held = opened["foreignobject"] or opened["desc"] or opened["title"]
            return state["unseen"] == "svg" and tag in BREAKOUT_TAGS and not held
        while opened[tag]:
            last = inner.pop()
            opened[last] -= 1
            if last == tag:
                return False
        return tag == state["unseen"] or tag == "a" and state["link"] or standing[tag] > 0

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if state["unseen"]:
            if not leaves(tag, closing):
                if tag in ("script", "style") and not closing:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at) if ended_later(tag) else None
                    at = end.end() if end else at
                elif not closing and tag not in VOID_TAGS and (tag in BLOCK_TAGS or not m["attrs"].endswith("/")):
                    inner.append(tag)
                    opened[tag] += 1
                continue
            ended, state["unseen"] = state["unseen"], None
            if closing and tag == ended:
                continue
        if tag in UNSEEN_TAGS:
            if not closing and tag not in VOID_TAGS and not m["attrs"].endswith("/"):
                if tag in RAW_TAGS:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else len(page)
                elif tag == "svg" or ended_later(tag):
                    state["unseen"] = tag
                    inner.clear()
                    opened.clear()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            state["link"] = not closing
        elif tag in BLOCK_TAGS:
            flush()
            state["link"] = False
            if closing:
                close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "body", "html") else set())
                continue
            if tag not in ("option", "optgroup", "button", "label"):
                close({"p"}, BLOCK_TAGS - {"p", "center"})
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            if tag in VOID_TAGS:
                continue
            words = " ".join(a or b or c for a, b, c in NAMES.findall(m["attrs"])) if m["attrs"] else ""
            state["serial"] += 1
            tags, names = stack[-1][1:3] if stack else (frozenset(), frozenset())
            more = {w.lower() for w in WORDS.findall(words)}
            if known is not None:
                more &= known
            stack.append((
                tag, tags if tag in tags else tags | {tag}, names if more <= names else names | more, state["serial"]))
            standing[tag] += 1
    flush()
    return found


def step(value: float, *limits: float) -> int:
    return sum(value >= x for x in limits)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = ["any", "own:" + b.own, f"words:{step(words, 4, 8, 15, 30, 60)}"]
        f += ["in:" + t for t in b.tags]
        f += ["name:" + n for n in b.names]
        share = b.linked / max(1, len(b.text) - b.text.count(" "))
        f.append(f"linked:{step(share, 0.01, 0.3, 0.7)}")
        f.append(f"end:{b.text[-1] in '.!?…:'}")
        f.append(f"commas:{step(b.text.count(','), 1, 3)}")
        if any(c in b.text for c in "©®|·•»›"):
            f.append("marks")
        f.append(f"place:{step(i / len(page), 0.05, 0.2, 0.5, 0.8, 0.95)}")
        if i == 0 or page[i - 1].holder != b.holder:
            f.append("first in holder")
        out.append(f)
    return out


# ---- the field


class Field:
    """Weights of features per label (0 other, 1 main) and of neighbouring labels."""

    def __init__(self, names: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.names, self.weights, self.trans, self.start = names, weights, trans, start
        self.words = frozenset(n[5:] for n in names if n.startswith("name:"))
        self.pull = (weights[:, 1] - weights[:, 0]).tolist()

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """Viterbi over the difference of the two labels' scores."""
        get, pull = self.index.get, self.pull
        (oo, om), (mo, mm) = self.trans.tolist()
        other, main = self.start.tolist()
        back = []
        for k, names in enumerate(rows):
            if k:
                from_other = (other + oo >= main + mo, other + om >= main + mm)
                other, main = max(other + oo, main + mo), max(other + om, main + mm)
                back.append(from_other)
            main += sum(pull[i] for i in map(get, names) if i is not None)
        label = main > other
        path = [label]
        for from_other in reversed(back):
            label = not from_other[label]
            path.append(label)
        return path[::-1] if rows else []

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(
            out, names=np.array(json.dumps(self.names)), weights=self.weights, trans=self.trans, start=self.start)
        return out.getvalue()


def unpack(model: bytes) -> Field:
    parts = np.load(io.BytesIO(model))
    return Field(json.loads(str(parts["names"])), parts["weights"], parts["trans"], parts["start"])


def train(pages: list[tuple[str, list[bool]]], rounds: int = 200, least: int = 2, decay: float = 1e-3) -> bytes:
    """Fit by Adam on the likelihood of whole label chains.

    ``pages`` holds each page's html and the label of each of its leaf blocks; a page whose labels do
    not match its blocks raises ValueError.
    """
    chains = []
    for source, labels in pages:
        rows = features(blocks(source))
        if len(rows) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(rows)} blocks")
        if rows:
            chains.append((rows, labels))
    seen: dict[str, int] = {}
    for rows, _ in chains:
        for name in {n for r in rows for n in r}:
            seen[name] = seen.get(name, 0) + 1
    names = sorted(n for n, c in seen.items() if c >= least)
    index = {n: i for i, n in enumerate(names)}
    count, longest = len(chains), max((len(r) for r, _ in chains), default=0)
    x = np.zeros((sum(len(r) for r, _ in chains), len(names)), np.float32)  # rows in the order of live
    at = 0
    gold = np.zeros((count, longest), np.intp)
    live = np.zeros((count, longest), bool)
    for c, (rows, labels) in enumerate(chains):
        for t, (row, label) in enumerate(zip(rows, labels)):
            x[at, [index[n] for n in row if n in index]] = 1
            gold[c, t], live[c, t] = int(label), True
            at += 1
    w = {"weights": np.zeros((len(names), 2)), "trans": np.zeros((2, 2)), "start": np.zeros(2)}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    one = np.eye(2)
    for r in range(1, (rounds if count else 0) + 1):
        score = np.zeros((count, longest, 2))
        score[live] = x @ w["weights"].astype(np.float32)
        ahead = np.zeros((count, longest, 2))
        after = np.zeros((count, longest, 2))
        ahead[:, 0] = score[:, 0] + w["start"]
        for t in range(1, longest):
            joined = np.logaddexp(*(ahead[:, t - 1, k, None] + w["trans"][k] for k in (0, 1)))
            ahead[:, t] = np.where(live[:, t, None], joined + score[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            further = score[:, t + 1] + after[:, t + 1]
            joined = np.logaddexp(*(w["trans"][:, k] + further[:, k, None] for k in (0, 1)))
            after[:, t] = np.where(live[:, t + 1, None], joined, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
        share = np.exp(ahead + after - whole) * live[..., None]
        miss = share - one[gold] * live[..., None]
        pair = np.exp(
            ahead[:, :-1, :, None] + w["trans"] + (score + after)[:, 1:, None, :] - whole[..., None])
        both = live[:, 1:, None, None]
        truth = one[gold[:, :-1]][..., :, None] * one[gold[:, 1:]][..., None, :]
        grads = {
            "weights": x.T @ miss[live].astype(np.float32) / count + decay * w["weights"],
            "trans": ((pair - truth) * both).sum((0, 1)) / count, "start": miss[:, 0].sum(0) / count,
        }
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= 0.1 * first[k] / (1 - 0.9**r) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)
    return Field(names, w["weights"], w["trans"], w["start"]).packed()


# ---- labelled pages


class Pages:
    """Labelled pages in the usual shapes of web sites: each part is written with its label."""

    def __init__(self, seed: int = 29):
        self.rng = random.Random(seed)

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiouäéó") for _ in range(r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 24) -> str:
        words = [self.word() + self.rng.choice([""] * 7 + [","]) for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize().rstrip(",") + self.rng.choice("....!?")

    def prose(self) -> str:
        """Sentences, now and then cut off, in capitals, with odd separators or repeated."""
        r = self.rng
        text = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
        if r.random() < 0.25:
            text = text[: r.randint(len(text) // 2, len(text))].strip()
        dice = r.random()
        if dice < 0.12:
            text = text.replace(" ", r.choice([" | ", " • ", "!! ", "%%% ", " &middot; "]))
        elif dice < 0.16:
            text = text.upper()
        elif dice < 0.2:
            text = " ".join([self.word()] * r.randint(3, 40))
        return text

    def label(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(1, 3))).capitalize()

    def links(self, low: int = 2, high: int = 8) -> list[str]:
        return [f'<a href="/{self.word()}">{self.label()}</a>' for _ in range(self.rng.randint(low, high))]

    def listed(self, items: list[str]) -> list[tuple[str, bool | None]]:
        out = [("<ul>", None)]
        for x in items:
            out += [(f"<li>{x}</li>", False)]
        return [*out, ("</ul>", None)]

    def boxed(self, tag: str, names: list[str], inner: list) -> list:
        r = self.rng
        name = r.choice(names) if names else ""
        attr = r.choice(["class", "class", "id"])
        return [(f'<{tag} {attr}="{name}">' if name else f"<{tag}>", None), *inner, (f"</{tag}>", None)]

    def other(self, kind: str) -> list:
        r = self.rng
        plain = lambda: [(f"<p>{self.sentence()}</p>", False)]
        if kind == "menu":
            return self.boxed(*r.choice([("nav", ["", "", "menu", "main-nav"]), ("div", ["menu", "navbar", "navigation"])]),
                              self.listed(self.links()))
        if kind == "header":
            inner = [(f"<h1>{self.label()}</h1>" if r.random() < 0.5 else f"<p>{self.label()}</p>", False)]
            return self.boxed(*r.choice([("header", ["", "site-header"]), ("div", ["header", "masthead", "topbar"])]),
                              inner + (plain() if r.random() < 0.4 else []))
        if kind == "crumbs":
            return self.boxed("div", ["breadcrumb", "breadcrumbs"], [(" &raquo; ".join(self.links(2, 4)), False)])
        if kind == "advert":
            text = r.choice([self.sentence, self.prose])()
            return self.boxed(r.choice(["div", "div", "aside", "section"]),
                              ["ad", "ad", "ads", "advert", "sponsored", "banner", "promo", "advertisement"],
                              [(text if r.random() < 0.6 else f"<p>{text}</p>", False)])
        if kind == "side":
            inner = [(f"<h3>{self.label()}</h3>", False), *self.listed(self.links()), *(plain() if r.random() < 0.6 else [])]
            return self.boxed(*r.choice([("aside", ["", "sidebar"]), ("div", ["sidebar", "side", "widget", "related"])]), inner)
        if kind == "notice":
            text = self.sentence() if r.random() < 0.7 else self.prose()
            return self.boxed("div", ["cookie-notice", "cookie", "notice", "consent", "alert", "popup", "banner"],
                              [(f"<p>{text}</p>", False), (f"<button>{self.label()}</button>", False)])
        if kind == "form":
            inner = [(f"<p>{self.sentence()}</p>" if r.random() < 0.5 else f"<h3>{self.label()}</h3>", False),
                     (f"<label>{self.label()}</label>", False), ('<input name="q">', None),
                     (f"<button>{self.label()}</button>", False)]
            return self.boxed("form", ["", "search", "newsletter", "login", "subscribe"], inner)
        if kind == "share":
            return self.boxed("div", ["share", "social", "tags", "pagination", "meta"], self.listed(self.links(2, 4)))
        if kind == "comments":
            inner = [(f"<h3>{self.label()}</h3>", False)]
            for _ in range(r.randint(1, 4)):
                inner += self.boxed(r.choice(["div", "li", "article"]), ["comment", "reply", "comment-body"],
                                    [(f"<p>{self.prose()}</p>", False)])
            return self.boxed(r.choice(["section", "div"]), ["comments", "comment-list", "responses", "discussion"], inner)
        mark = r.choice(["&copy; ", "&copy; 2020 ", "© "]) if r.random() < 0.8 else ""
        inner = [(f"{mark}{self.word()}.example.com {r.choice(['&middot;', '|', '-'])} {self.sentence()}", False)]
        if r.random() < 0.4:
            inner = [(f"<p>{inner[0][0]}</p>", False), *self.listed(self.links(2, 5))]
        return self.boxed(*r.choice([("footer", ["", "", "footer"]), ("div", ["footer", "site-footer", "copyright"])]), inner)

    def main(self) -> list:
        r = self.rng
        inner = []
        title = self.sentence(4, 12).rstrip(".!?")
        if r.random() < 0.9:
            inner.append((f"<h1>{title}</h1>", True))
        for _ in range(r.randint(1, 9)):
            dice = r.random()
            if dice < 0.72:
                text = self.prose()
                if r.random() < 0.2:
                    text = text.replace(" ", f' <a href="#">{self.word()}</a> ', 1)
                shape = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><em>{}</em></p>", "<div>{}</div>"])
                inner.append((shape.format(text), True))
            elif dice < 0.82:
                inner.append((f"<h2>{self.label()}</h2>", True))
            elif dice < 0.9:
                tag = r.choice(["ul", "ol"])
                inner += [(f"<{tag}>", None)]
                inner += [(f"<li>{self.sentence(2, 10)}</li>", True) for _ in range(r.randint(2, 5))]
                inner += [(f"</{tag}>", None)]
            else:
                inner.append((r.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figcaption>{}</figcaption>",
                                        "<table><tr><td>{}</td></tr></table>"]).format(self.sentence()), True))
            if r.random() < 0.08:
                inner += self.other(r.choice(["advert", "share", "side", "form", "notice"]))
        box = r.choice([
            ("article", ["", "", "post"]), ("article", [""]), ("main", ["", "content"]),
            ("div", ["content", "article-body", "post", "entry-content", "main", "story", "text"]), ("section", ["article"]),
        ])
        if r.random() < 0.15:
            inner += self.other("comments")
        return self.boxed(*box, inner)

    def page(self) -> tuple[str, list[bool]]:
        r = self.rng
        before = [k for k in ("header", "menu", "crumbs", "notice", "form", "advert", "side") if r.random() < 0.45]
        after = [k for k in ("share", "advert", "comments", "side", "form", "menu", "notice") if r.random() < 0.3]
        r.shuffle(before)
        parts = [("<html><head><title>", None), (self.label(), None), ("</title><style>p{margin:0}</style></head><body>", None)]
        for k in before:
            parts += self.other(k)
        parts += self.main()
        for k in after:
            parts += self.other(k)
        if r.random() < 0.9:
            parts += self.other("footer")
        return "".join(t for t, _ in parts) + "</body></html>", [label for _, label in parts if label is not None]


def labelled_pages(count: int = 600, seed: int = 29) -> list[tuple[str, list[bool]]]:
    made = Pages(seed)
    return [made.page() for _ in range(count)]


# ---- the operator


def main_text(page: str, field: Field) -> str:
    found = blocks(page, field.words)
    return "\n".join(b.text for b, main in zip(found, field.decode(features(found))) if main)


def extract(pages: DataFrame, model: bytes, keep: list[str]) -> DataFrame:
    """The main ``text`` of each page's ``html`` and its ``n_chars``; NULL and empty pages give ''.

    Repeated rows are each kept; other columns than ``keep`` are dropped. The model is a few hundred
    weights.
    """
    def work(buf, offsets, field, part):
        raw, cut = buf.tobytes(), offsets.tolist()
        texts = [main_text(raw[a:b].decode(errors="replace"), field) for a, b in zip(cut, cut[1:])]
        return [pa.array(texts, pa.string())]

    names = [f"k{i}" for i in range(len(keep))]
    chosen = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], "html")
    fields = [T.StructField("text", T.StringType())]
    found = map_slices(chosen, "html", names, work, fields, prepare=lambda: once("field", model, unpack))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "text",
                        F.length("text").cast("bigint").alias("n_chars"))

"""Main-text extraction from HTML by a recurrent block labeller.

A page is read into its leaf blocks: the runs of text between block-level tags, with the path of
open elements. A block's vector holds hashed tag-path tokens (element names, the words of class
and id), hashed words and a few measures (length, share of link text, punctuation). A
bidirectional LSTM, trained and run in numpy, reads the page's sequence of vectors both ways and
labels every block as main text or not, so each label depends on the whole document. The text of
a page is its main blocks in order, joined by one space.

The network is fitted here on pages that :func:`synthetic_page` makes up from a fixed seed, as
no table marks main text; the model (about 100 kB) is broadcast.

Whole pages are read, however long. Scripts, styles, titles, templates, comments and what forms
hold as values are never text. Defined results: null and empty pages have an empty text; markup
that is cut off or wrongly nested is read as far as it goes; repeated rows are read each for itself.
"""

from __future__ import annotations

import functools
import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_DIM, HIDDEN = 32, 16
MEASURES = 6
#: Blocks of a page that are held as vectors at once.
STEPS = 4096
PAGES, EPOCHS, BATCH, RATE, SEED = 1500, 9, 20, 0.01, 5

# HTML element classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title template noscript textarea iframe svg object select datalist".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div article section body main aside nav header footer form".split())

# Words that class and id attributes of page parts are made of.
NAMES = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav mainmenu links pagination pager".split(),
    "header": "header masthead topbar banner logo branding site tagline".split(),
    "footer": "footer foot bottom copyright legal colophon credits".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending archive secondary rail teaser".split(),
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion adbox dfp banner commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe announcement disclaimer paywall".split(),
    "comments": "comment comments commentlist discussion replies reply respond disqus reader feedback thread".split(),
    "form": "form search searchform login signup contact register".split(),
    "share": "share sharing social follow buttons tools tags meta".split(),
    "main": "content article post entry story body main text page blog single news prose".split(),
}
#: Path tokens with a slot of their own; others share hashed slots.
KNOWN_TAGS = (*"html body main article section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure figcaption button label dialog ins".split(), *sorted(INLINE - {"ins", "label"}))
_OWN = {t: i for i, t in enumerate(dict.fromkeys([*KNOWN_TAGS, *("." + w for ws in NAMES.values() for w in ws), *("last " + t for t in KNOWN_TAGS)]))}
HASHED = 48
PATH_DIM = len(_OWN) + HASHED

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class _Tags:
    """Finds where tags end, in time linear in the page however it is broken.

    A tag ends at the first ``>`` outside quotes, or where a quote is never closed at the first
    ``>`` of all. Quotes from which no such end was reached are remembered.
    """

    def __init__(self, page: str):
        self.page, self.next, self.dead = page, 0, set()

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1: none."""
        if self.next >= 0 and self.next < at:
            self.next = self.page.find(">", at)
        if self.next < 0 or self.page.find('"', at, self.next) < 0 and self.page.find("'", at, self.next) < 0:
            return self.next
        seen, i = [], at
        while (m := _STOP.search(self.page, i)) and m[0] != ">" and m.start() not in self.dead:
            seen.append(m.start())
            i = self.page.find(m[0], m.end()) + 1
            if not i:
                break
        if i and m and m[0] == ">":
            return m.start()
        self.dead.update(seen)
        return self.next


class _Open:
    """The elements that are open, and their path as counts of its tokens' slots."""

    def __init__(self):
        self.stack: list[tuple[str, list[int]]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[str] = []  # those that aren't inline
        self.slots = np.zeros(PATH_DIM, np.int32)

    def push(self, name: str, slots: list[int]) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, slots))
        if name not in INLINE:
            self.solid.append(name)
        for s in slots:
            self.slots[s] += 1

    def close(self, names, scope=frozenset()) -> None:
        """Close the innermost element of names and all within it, unless one of scope is nearer."""
        at = -1
        for n in names:
            if (places := self.places.get(n)) and places[-1] > at:
                at = places[-1]
        if at < 0 or any(places[-1] > at for n in scope if (places := self.places.get(n))):
            return
        while len(self.stack) > at:
            name, slots = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.solid.pop()
            for s in slots:
                self.slots[s] -= 1

    def path(self) -> np.ndarray:
        """Whether each slot is on the path; the innermost block element has a slot of its own."""
        out = self.slots > 0
        if self.solid:
            out[_path_slot("last " + self.solid[-1])] = True
        return out


def blocks(page: str | None) -> list[tuple[np.ndarray, str, float]]:
    """(slots of the path, text, share of link text) of each leaf block, in page order."""
    page = page or ""
    open_, tags = _Open(), _Tags(page)
    out: list[tuple[np.ndarray, str, float]] = []
    held: list[str] = []
    linked, path = 0, open_.path()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((path, text, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, path
        if not text:
            return
        if not held:
            if text.isspace():
                return
            path = open_.path()
        held.append(text)
        if open_.places.get("a"):
            linked += len(text.strip())

    at = i = 0
    while (i := page.find("<", i)) >= 0:
        if page.startswith(("<!", "<?"), i):
            add(page[at:i])
            comment = page.startswith("<!--", i)
            end = page.find("-->", i + 4) if comment else page.find(">", i + 2)
            at = i = len(page) if end < 0 else end + 3 * comment + (not comment)
            continue
        closing = page.startswith("/", i + 1)
        named = _NAME.match(page, i + 1 + closing)
        if not named:
            i += 1
            continue
        end = tags.end(named.end())
        if end < 0:
            break  # no tag ends any more: the rest is text
        add(page[at:i])
        name, rest = named[0].lower(), page[named.end() : end]
        at = i = end + 1
        if not closing and name in UNREAD and not rest.endswith("/"):
            if name not in INLINE:
                flush()
            over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = i = over.end() if over else len(page)
            continue
        if name not in INLINE:
            flush()
        if closing:
            open_.close((name,))
        elif name not in VOID:
            if name in CLOSES_P:
                open_.close(("p",), SCOPES)
            if name in SIBLINGS:
                open_.close(SIBLINGS[name], SCOPES - {"div"} if name == "li" else SCOPES)
            if not rest.endswith("/"):
                words = ("." + w.lower() for found in _NAMED.findall(rest) for w in _PARTS.findall("".join(found)))
                open_.push(name, [_path_slot(t) for t in (name, *words)])
    add(page[at:])
    flush()
    return out


_slots: dict[str, int] = {}


def _slot(token: str, dim: int, salt: str) -> int:
    key = salt + token
    if key not in _slots:
        if len(_slots) > 300_000:
            _slots.clear()
        _slots[key] = zlib.crc32(key.encode("utf-8", "replace")) % dim
    return _slots[key]


def _path_slot(token: str) -> int:
    own = _OWN.get(token)
    return len(_OWN) + _slot(token, HASHED, "p") if own is None else own


def vectors(found: list[tuple[np.ndarray, str, float]], first: int = 0, of: int | None = None) -> np.ndarray:
    """Vectors of blocks, the first of which is number ``first`` of the page's ``of``."""
    x = np.zeros((len(found), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    of = of or len(found)
    for i, (path, text, links) in enumerate(found):
        x[i, :PATH_DIM] = path
        words = text.split(" ")
        n = np.bincount([_slot(w, WORD_DIM, "w") for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = n / math.sqrt(float((n * n).sum()))
        x[i, PATH_DIM + WORD_DIM :] = (math.log1p(len(words)) / 4, links, text[-1] in ".!?", sum(map(text.count, ",;.")) / len(words) / 2, (first + i) / of, 1)
    return x


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = PATH_DIM + WORD_DIM + MEASURES
    model = {"o": rng.normal(0, 0.1, 2 * HIDDEN + d), "ob": np.zeros(1)}
    for way in "fb":
        model[f"w{way}"] = rng.normal(0, 1 / math.sqrt(20), (d, 4 * HIDDEN))
        model[f"u{way}"] = rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        model[f"b{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w, u, b, keep: bool, state=None):
    """States of one direction over x (pages, steps, d); padded steps carry the state on."""
    n, steps, _ = x.shape
    gates_in = x @ w + b
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out, cache = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        a = gates_in[:, t] + h @ u
        i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            cache.append((i, f, o, g, c, tc, h))
        c, h = np.where(m, new, c), np.where(m, o * tc, h)
        out[:, t] = h
    return out, cache if keep else (h, c)


def _lstm_back(dout: np.ndarray, x, mask, w, u, cache):
    n, steps, d = x.shape
    da_all = np.zeros((n, steps, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        i, f, o, g, c, tc, h = cache[t]
        m = mask[:, t, None]
        dh = dh + dout[:, t]
        own = dh * m
        dct = dc * m + own * o * (1 - tc * tc)
        a = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), own * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
        da_all[:, t] = a
        du += h.T @ a
        dh = a @ u.T + dh * ~m
        dc = dct * f + dc * ~m
    flat = da_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, d).T @ flat, du, flat.sum(0)


def _batch(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(seqs), max(map(len, seqs)), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    return x, mask


def _forward(model: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    hf, cf = _lstm(x, mask, model["wf"], model["uf"], model["bf"], keep)
    hb, cb = _lstm(x[:, ::-1], mask[:, ::-1], model["wb"], model["ub"], model["bb"], keep)
    feats = np.concatenate([hf, hb[:, ::-1], x], 2)
    return _sigmoid(feats @ model["o"] + model["ob"]), feats, cf, cb


def train(pages: int = PAGES, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        found = blocks(synthetic_page(rng))
        y = np.array([MAIN in t for _, t, _ in found], np.float32)
        found = [(p, t.translate(_UNMARK), n) for p, t, n in found]
        data.append((vectors([(p, t.strip() or "-", n) for p, t, n in found]), y))
    model = initial(rng)
    m, v, step = {k: np.zeros_like(a) for k, a in model.items()}, {k: np.zeros_like(a) for k, a in model.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][1]) // 12 for i in order], kind="stable")]
        starts = rng.permutation(range(0, len(order), BATCH))
        for at in starts:
            part = [data[i] for i in order[at : at + BATCH]]
            x, mask = _batch([p for p, _ in part])
            keep = rng.random(x.shape[2]) > 0.05  # now and then a feature is hidden
            x = x * keep
            y = np.zeros(mask.shape, np.float32)
            for i, (_, own) in enumerate(part):
                y[i, : len(own)] = own
            p, feats, cf, cb = _forward(model, x, mask, True)
            d = (p - y) * mask / mask.sum()
            g = {"o": (feats * d[..., None]).sum((0, 1)), "ob": np.array([d.sum()])}
            dh = d[..., None] * model["o"][: 2 * HIDDEN]
            g["wf"], g["uf"], g["bf"] = _lstm_back(dh[..., :HIDDEN], x, mask, model["wf"], model["uf"], cf)
            g["wb"], g["ub"], g["bb"] = _lstm_back(dh[:, ::-1, HIDDEN:], x[:, ::-1], mask[:, ::-1], model["wb"], model["ub"], cb)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
            for k, a in model.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def _long(model: dict, found: list) -> np.ndarray:
    """Chances of the blocks of one page of any length, whose vectors are made STEPS at a time."""
    n, states = len(found), {}
    for way, starts in (("f", range(0, n, STEPS)), ("b", reversed(range(0, n, STEPS)))):
        states[way], state = np.zeros((n, HIDDEN), np.float32), None
        turn = 1 if way == "f" else -1
        for at in starts:
            x = vectors(found[at : at + STEPS], at, n)[None, ::turn]
            h, state = _lstm(x, np.ones(x.shape[:2], bool), model["w" + way], model["u" + way], model["b" + way], False, state)
            states[way][at : at + STEPS] = h[0, ::turn]
    out = [np.concatenate([states["f"][at : at + STEPS], states["b"][at : at + STEPS], vectors(found[at : at + STEPS], at, n)], 1) @ model["o"] + model["ob"] for at in range(0, n, STEPS)]
    return _sigmoid(np.concatenate(out))


def extract(pages: list[str | None], model: dict) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        n = max(1, min(64, STEPS // len(found[order[at]])))
        part = order[at : at + n]
        at += n
        if len(found[part[0]]) > STEPS:
            p = _long(model, found[part[0]])
            out[part[0]] = " ".join(t for (_, t, _), y in zip(found[part[0]], p, strict=True) if y >= 0.5)
            continue
        x, mask = _batch([vectors(found[i]) for i in part])
        p = _forward(model, x, mask)[0]
        for row, i in enumerate(part):
            out[i] = " ".join(t for k, (_, t, _) in enumerate(found[i]) if p[row, k] >= 0.5)
    return out


MAIN, OTHER = "", ""
_UNMARK = {ord(MAIN): " ", ord(OTHER): " "}
_HINTS = {
    "nav": "home about contact news blog next previous".split(),
    "footer": "© copyright rights reserved privacy terms".split(),
    "ad": "advertisement sponsored buy sale offer".split(),
    "notice": "cookies accept consent privacy subscribe newsletter".split(),
    "comments": "reply says wrote commented thanks".split(),
    "sidebar": "related popular recent posts archives".split(),
    "form": "name email search submit password".split(),
    "share": "share tweet facebook print email".split(),
    "header": "welcome home of the".split(),
}


def synthetic_page(rng: np.random.Generator) -> str:
    """A made-up page; main blocks hold MAIN, the others OTHER."""
    letters = list("etaoinshrdlucmfwypvbgkqjxzäöüßéèçñóí")
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(letters[int(i)] for i in rng.integers(0, len(letters), int(rng.integers(1, 9))))

    def text(kind: str, low: int, high: int) -> str:
        mark = MAIN if kind == "main" else OTHER
        words = [pick(_HINTS[kind]) if kind in _HINTS and rng.random() < 0.25 else word() for _ in range(int(rng.integers(low, high)))]
        words = [w + pick([".", ",", "", "", "", "", "&amp;", ""]) for w in words]
        if kind == "main" and len(words) > 3 and rng.random() < 0.3:
            k = int(rng.integers(1, len(words) - 1))
            words[k] = pick(["<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<em>{}", "<span>{}</span>"]).format(words[k])
        line = " ".join(words)
        return mark + (line[:1].upper() + line[1:] if rng.random() < 0.7 else line) + (pick([".", ".", "!", "?", ""]) if kind != "nav" else "")

    def attrs(kind: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return f' class="{word()}"' if rng.random() < 0.3 else ""
        names = [pick(NAMES[kind])] + [pick([word(), pick(NAMES[kind]), "wrap", "container", "inner", "box", "list", "item", "area", "block"]) for _ in range(int(rng.integers(0, 3)))]
        return f' {pick(["class", "class", "id"])}="{pick(["-", "_", " "]).join(names)}"'

    def para(kind: str, low: int = 3, high: int = 30) -> str:
        return pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>"]).format(text(kind, low, high)) + "\n"

    def links(kind: str, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{text(kind, 1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def boxed(kind: str, tag: str, inner: str, chance: float = 0.85) -> str:
        return f"<{tag}{attrs(kind, chance)}>{inner}</{tag}>\n"

    def part(kind: str) -> str:
        n = int(rng.integers(1, 5))
        if kind == "nav":
            return boxed(kind, *pick([("nav", links(kind, n + 2)), ("div", links(kind, n + 2))]), chance=0.5) if rng.random() < 0.5 else boxed(kind, "nav", links(kind, n + 2), 0.3)
        if kind == "header":
            tag = pick(["header", "header", "div"])
            return boxed(kind, tag, pick([f"<h1>{text(kind, 1, 5)}</h1>", f"<a href='/'>{text(kind, 1, 4)}</a>", f"<p>{text(kind, 2, 8)}</p>"]) + (links("nav", 3) if rng.random() < 0.4 else ""), 0.3 if tag == "header" else 1)
        if kind == "footer":
            tag = pick(["footer", "footer", "div"])
            return boxed(kind, tag, pick([f"&copy; {text(kind, 2, 10)}", para(kind, 2, 12), links(kind, n) + text(kind, 2, 8)]), 0.3 if tag == "footer" else 1)
        if kind == "sidebar":
            tag = pick(["aside", "aside", "div", "section"])
            return boxed(kind, tag, f"<h3>{text(kind, 1, 4)}</h3>" + pick([links(kind, n), para(kind, 3, 20) * 1, links(kind, n) + para(kind)]), 0.4 if tag == "aside" else 1)
        if kind == "ad":
            tag = pick(["div", "div", "aside", "section", "p", "ins"])
            return "<!-- ad -->" * int(rng.random() < 0.3) + boxed(kind, tag, text(kind, 2, 25) if rng.random() < 0.7 else f'<a href="/">{text(kind, 2, 12)}</a>', 1)
        if kind == "notice":
            return boxed(kind, pick(["div", "section", "p", "aside", "dialog"]), pick([text(kind, 3, 20), para(kind, 3, 20), text(kind, 3, 12) + "<button>" + text(kind, 1, 3) + "</button>"]), 1)
        if kind == "form":
            return f"<form{attrs(kind, 0.5)}><label>{text(kind, 1, 4)}</label><input name=q>" + (f"<p>{text(kind, 2, 12)}</p>" if rng.random() < 0.5 else "") + f"<button>{text(kind, 1, 3)}</button></form>\n"
        if kind == "share":
            return boxed(kind, "div", pick([links(kind, n), text(kind, 1, 6)]), 1)
        inner = f"<h3>{text(kind, 1, 4)}</h3>" * int(rng.random() < 0.6)
        items = [f"{para(kind, 3, 40)}" for _ in range(n)]
        inner += pick([lambda: "<ol>" + "".join(f"<li{attrs(kind, 0.5)}>{i}</li>" for i in items) + "</ol>", lambda: "".join(f"<div{attrs(kind, 0.7)}>{i}</div>" for i in items), lambda: "".join(f"<article{attrs(kind, 1)}>{i}</article>" for i in items)])()
        return boxed(kind, pick(["section", "div", "div", "aside"]), inner, 1)

    def story() -> str:
        bits = [f"<h1>{text('main', 2, 10)}</h1>"] * int(rng.random() < 0.85)
        if bits and rng.random() < 0.2:
            bits = [f"<header>{bits[0]}</header>"]
        for _ in range(int(rng.integers(1, 9)) if rng.random() < 0.8 else int(rng.integers(9, 30))):
            r = rng.random()
            if r < 0.12:
                bits.append(para("main", 1, 5))
            elif r < 0.68:
                bits.append(para("main", 1, 60 if rng.random() < 0.9 else 300))
            elif r < 0.74:
                bits.append(f"<h{int(rng.integers(2, 5))}>{text('main', 1, 7)}</h2>")
            elif r < 0.80:
                bits.append("<ul>" + "".join(f"<li>{text('main', 1, 15)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif r < 0.84:
                bits.append(f"<blockquote>{para('main')}</blockquote>")
            elif r < 0.87:
                bits.append(f"<table><tr><td>{text('main', 1, 5)}</td><td>{text('main', 1, 5)}</td></tr></table>")
            elif r < 0.90:
                bits.append(pick([f"<pre>{text('main', 1, 20)}</pre>", f"<figure><img src=x><figcaption>{text('main', 2, 9)}</figcaption></figure>"]))
            elif len(bits) > 2:
                bits.append(part(pick(["ad", "share", "sidebar", "notice", "form"])))
        if rng.random() < 0.2:
            bits.append(part(pick(["comments", "comments", "share", "footer"])))
        inner = "".join(bits)
        how = rng.random()
        if how < 0.5:
            return f"<article{attrs('main', 0.4)}>{inner}</article>"
        if how < 0.65:
            return f"<main{attrs('main', 0.4)}>{inner}</main>"
        if how < 0.75:
            after = part(pick(["comments", "comments", "sidebar", "share", "form"])) if rng.random() < 0.5 else ""
            return f"<main><article{attrs('main', 0.3)}>{inner}</article>{after}</main>"
        if how < 0.93:
            return boxed("main", pick(["div", "section"]), inner, 1)
        return inner

    if rng.random() < 0.06:  # nothing but text
        bare = "".join(para("main") for _ in range(int(rng.integers(1, 4)))) if rng.random() < 0.7 else text("main", 1, 40)
        return pick([bare, f"<html><body>{bare}</body></html>", f"<div>{bare}</div>"])
    kinds = ["nav", "header", "ad", "notice", "sidebar", "form", "share"]
    top = [part(k) for k in kinds if rng.random() < {"nav": 0.7, "header": 0.5}.get(k, 0.2)]
    rng.shuffle(top)
    tail = [part(k) for k in ["share", "comments", "sidebar", "ad", "form", "notice", "nav"] if rng.random() < {"comments": 0.4}.get(k, 0.15)]
    if rng.random() < 0.8:
        tail.append(part("footer"))
    script = "<script>if (a < b) document.write('<p>no</p>')</script>" if rng.random() < 0.3 else ""
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>{''.join(top)}{script}{story()}{''.join(tail)}</body></html>"


@functools.cache
def fitted() -> dict[str, np.ndarray]:
    """The network, fitted once in a driver: the seed is fixed, so every fit is the same."""
    return train()


def main_text(pages: DataFrame, model: dict | None = None, key: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


digest = main_text

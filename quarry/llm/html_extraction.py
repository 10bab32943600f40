"""Main-text extraction from HTML by a linear-chain conditional random field.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block
has binary features: its tag and ancestors' tags, words of their class, id and role
attributes, shape of its text (length, links, punctuation), and its place: how far down
the page it is, how long beside the longest block, and the shape of the blocks around it.
A linear-chain CRF with two labels, main text and rest, is trained on labelled pages by
its conditional likelihood and decodes a page's blocks by Viterbi; of equally good
labellings it takes the one with less main text.

The labelled pages are generated here: common page layouts with random words, so that
nothing but structure tells main text from the rest. A third of them have no telling names at
all, so that a page whose names say nothing is judged by the rest of the features.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements whose content is not text, elements without content, and those that break lines.
_RAW = frozenset("script style title noscript template svg iframe object math canvas audio video".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section select option optgroup button textarea label legend summary table tbody thead tfoot td th tr ul caption".split()
)
_CLOSES_P = _BLOCK - frozenset("option optgroup button label select textarea".split())


@dataclass
class Block:
    text: str
    features: list[str]
    words: int = 0
    links: int = 0  # quarters of the text that are links, rounded down
    zone: str = "silent"  # what the names and kinds of the elements around it say: inside (main text), outside or silent

    @property
    def flows(self) -> bool:
        """Whether it looks like a paragraph: many words, few of them links."""
        return self.words >= 15 and not self.links


class _OpenElements:
    """The open elements of a page; what blocks need of all of them is kept up to date at each push and pop."""

    def __init__(self, known: Container[str] | None) -> None:
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []  # name, words, features
        self.depths: dict[str, list[int]] = {name: [] for name in _BLOCK}  # of the open elements of each name
        self.features: dict[str, int] = {}  # how many open elements have each
        self.worded: list[tuple[str, ...]] = []  # the words of those that have some
        self.links: list[int] = []  # depths of links

    def push(self, name: str, words: tuple[str, ...], link: bool) -> None:
        found = {f"in:{name}"} if name in _BLOCK else set()
        for word in words:
            found.add(f"word:{word}")
            if len(word) > 4:
                found.add(f"head:{word[:4]}")
        features = tuple(x for x in found if self.known is None or x in self.known)
        for x in features:
            self.features[x] = self.features.get(x, 0) + 1
        if name == "a":
            self.links.clear()  # a link ends where the next anchor begins
            if link:
                self.links.append(len(self.stack))
        if words:
            self.worded.append(words)
        self.depths.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, words, features))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, words, features = self.stack.pop()
            self.depths[name].pop()
            if words:
                self.worded.pop()
            for x in features:
                self.features[x] -= 1
                if not self.features[x]:
                    del self.features[x]
        while self.links and self.links[-1] >= depth:
            self.links.pop()

    def last(self, *names: str) -> int:
        """The depth of the innermost open element of these names, or -1."""
        return max((self.depths[name][-1] for name in names if self.depths.get(name)), default=-1)


def leaf_blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The non-empty leaf blocks of a whole page, in page order.

    known: the features of ancestors that are wanted, all if None; so that a page of ever
    deeper elements with ever new words makes no more features than a model has.
    """
    page = page or ""
    opened = _OpenElements(known)
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            n, quarters = text.count(" ") + 1, min(4, 4 * linked // len(text))
            zone = _zone(opened.features)
            blocks.append(Block(text, _features(text, opened, n, quarters, zone), n, quarters, zone))
        linked = 0

    size = len(page)
    while at < size:
        tag = _TAG.search(page, at)
        end = tag.start() if tag else size
        if end > at:
            piece = page[at:end]
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if opened.links:
                linked += len(piece.strip())
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if tag["close"]:
            if name in _BLOCK:
                flush()
            if opened.depths.get(name):
                opened.pop_to(opened.last(name))
            continue
        if name in _RAW:
            if name in _BLOCK:
                flush()
            if not tag["attrs"].endswith("/>"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                depth = opened.last("p")
                if depth > opened.last("div", "article", "section", "body", "td", "li", "main", "blockquote"):
                    opened.pop_to(depth)
            if name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                depth = opened.last(name, "th" if name == "td" else name)
                if depth > opened.last("ul", "ol", "table", "dl", "select"):
                    opened.pop_to(depth)
        if name == "br":
            parts.append(" ")
        if name in _VOID or tag["attrs"].endswith("/>"):
            continue
        words: list[str] = []
        if "=" in tag["attrs"]:
            for found in _ATTRIBUTE.findall(tag["attrs"]):
                words += _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower())
        opened.push(name, tuple(words), name == "a" and _HREF.search(tag["attrs"]) is not None)
    flush()
    _place(blocks)
    return blocks


def _place(blocks: list[Block]) -> None:
    """Adds to each block the features of its place among the others."""
    longest, total = max((b.words for b in blocks), default=1), max(1, sum(b.words for b in blocks))
    done = 0
    for i, b in enumerate(blocks):
        around = [x.flows for x in blocks[max(0, i - 3) : i] + blocks[i + 1 : i + 4]]
        b.features += [f"beside:{min(6, (longest // b.words).bit_length())}", f"at:{5 * done // total}", f"flow:{min(3, sum(around))}", f"blocks:{min(5, len(blocks).bit_length())}"]
        b.features += [f"shape:{min(5, b.words.bit_length())}:{b.links}", f"flow:{min(3, sum(around))}:{b.links}:{min(4, b.words.bit_length())}"]
        shape = f"{min(5, b.words.bit_length())}:{b.links}"
        b.features += [b.zone, f"{b.zone}:{shape}", f"{b.zone}:flow:{min(3, sum(around))}:{b.links}", f"{b.zone}:beside:{min(4, (longest // b.words).bit_length())}:{b.links}"]
        for name, j in (("before", i - 1), ("after", i + 1)):
            if 0 <= j < len(blocks):
                b.features += [f"{name}:{min(5, blocks[j].words.bit_length())}", f"{name}:links:{blocks[j].links}"]
            else:
                b.features.append(f"{name}:none")
        done += b.words


def _features(text: str, opened: _OpenElements, n: int, quarters: int, zone: str) -> list[str]:
    blocks = sorted(((depths[-1], name) for name in _BLOCK if (depths := opened.depths[name])), reverse=True)
    own = blocks[0][1] if blocks else "none"
    up = next((name for _, name in blocks if name not in (own, "p", "b")), "none")
    found = {"bias", f"own:{own}", f"{zone}:own:{own}", f"up:{up}>{own}", *opened.features}
    found |= {f"near:{word}" for word in (opened.worded[-1] if opened.worded else ())}
    found.add(f"words:{min(6, n.bit_length())}")
    found.add(f"links:{quarters}")
    if text[-1] in ".!?…":
        found.add("stops")
    if "©" in text:
        found.add("copyright")
    if not any(map(str.isalnum, text)):
        found.add("signs")
    return sorted(found)


@dataclass(frozen=True)
class TaggerModel:
    """Weights of main text against the rest for each feature, and of label changes."""

    weights: dict[str, float]
    moves: np.ndarray  # [from, to]; from 2 at the start of a page

    def labels(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels of a page's blocks, by Viterbi."""
        if not blocks:
            return []
        (m00, m01), (m10, m11), (s0, s1) = self.moves.tolist()
        weights = self.weights
        rest, main, back = s0, s1, []
        for i, block in enumerate(blocks):
            if i:
                up = (rest + m01, main + m11)
                down = (rest + m00, main + m10)
                back.append((down[1] > down[0], up[1] > up[0]))
                rest, main = max(down), max(up)
            main += sum(weights.get(f, 0.0) for f in block.features)
        label = main > rest
        out = [label]
        for from_rest, from_main in reversed(back):
            label = from_main if label else from_rest
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page, self.weights)
        return " ".join(b.text for b, keep in zip(blocks, self.labels(blocks)) if keep)


def page_gradient(scores: list[float], labels: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of a page's conditional log-likelihood, by forward and backward sums, and the log-likelihood.

    scores: of each block as main text against the rest. (by each block's score, by moves, value).
    """
    n = len(scores)
    emit = np.zeros((n, 2))
    emit[:, 1] = scores
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = moves[2] + emit[0]
    for i in range(1, n):
        ahead[i] = emit[i] + np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1])
    for i in range(n - 2, -1, -1):
        step = emit[i + 1] + behind[i + 1]
        behind[i] = np.logaddexp(moves[:2, 0] + step[0], moves[:2, 1] + step[1])
    total = np.logaddexp(*ahead[-1])
    move_grad = np.zeros((3, 2))
    move_grad[2, labels[0]] += 1
    move_grad[2] -= np.exp(ahead[0] + behind[0] - total)
    own = moves[2, labels[0]] + emit[np.arange(n), labels].sum()
    if n > 1:
        np.add.at(move_grad, (labels[:-1], labels[1:]), 1)
        both = ahead[:-1, :, None] + moves[None, :2] + (emit[1:] + behind[1:])[:, None, :] - total
        move_grad[:2] -= np.exp(both).sum(0)
        own += moves[labels[:-1], labels[1:]].sum()
    return labels - np.exp(ahead[:, 1] + behind[:, 1] - total), move_grad, float(own - total)


def fit(pages: list[tuple[list[Block], list[bool]]], epochs: int = 14, ridge: float = 2e-3) -> TaggerModel:
    """Stochastic gradient ascent on the conditional log-likelihood of labelled pages."""
    names = {f: i for i, f in enumerate(sorted({f for blocks, _ in pages for b in blocks for f in b.features}))}
    coded = [([np.array([names[f] for f in b.features]) for b in blocks], np.array(labels, int)) for blocks, labels in pages if blocks]
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    moves, move_squares = np.zeros((3, 2)), np.full((3, 2), 1e-6)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for k in rng.permutation(len(coded)):
            blocks, labels = coded[k]
            error, move_grad, _ = page_gradient([weights[b].sum() for b in blocks], labels, moves)
            grad = -ridge * weights
            for b, e in zip(blocks, error):
                grad[b] += e
            squares += grad**2
            move_squares += move_grad**2
            weights += 0.3 * grad / np.sqrt(squares)
            moves += 0.3 * move_grad / np.sqrt(move_squares)
    return TaggerModel({f: float(weights[i]) for f, i in names.items()}, moves)


#: Usual names of page parts in class and id attributes.
_MAIN_NAMES = "content main post entry article story body text post-content entry-content article-body main-content page-content story-body post-body articleBody single hentry".split()
_REST_NAMES = {
    "menu": "nav navbar menu navigation main-menu topbar breadcrumb breadcrumbs pagination pager toolbar tabs site-nav skip-links hauptmenue navigation-principale navegacion".split(),
    "head": "header masthead site-header page-header banner logo branding top kopfzeile entete cabecera".split(),
    "foot": "footer site-footer page-footer copyright legal bottom colophon fusszeile impressum pied-de-page pie-de-pagina".split(),
    "side": "sidebar side aside widget widgets related related-posts recommended popular trending most-read tags tagcloud archive-list author-box share social sharing follow seitenleiste barre-laterale barra-lateral".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert message popup modal overlay newsletter subscribe paywall disclaimer announcement hinweis avis aviso".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner-ad ad-slot dfp outbrain taboola werbung anzeige publicite publicidad anuncio".split(),
    "form": "search search-form login signup contact-form form subscribe-form suche recherche buscar".split(),
    "comment": "comments comment comment-list commentlist comment-body comment-text reply replies respond disqus discussion reader-comments responses reviews kommentare kommentar commentaires commentaire comentarios leserbriefe".split(),
}


#: Usual names of containers that say nothing about their content.
_PLAIN_NAMES = "row col col-md-8 col-12 column container container-fluid inner wrap wrapper outer layout grid flex app root site block section region pane panel box holder clearfix group".split()


def _name_features(names: list[str]) -> set[str]:
    return {f"word:{part}" for name in names for part in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())}


#: Features of ancestors that say main text, and those that say the rest.
_INSIDE = frozenset({"in:article", "in:main"} | _name_features(_MAIN_NAMES))
_OUTSIDE = frozenset({"in:nav", "in:header", "in:footer", "in:aside", "in:form"} | _name_features([n for names in _REST_NAMES.values() for n in names])) - _INSIDE - _name_features(["list", "site", "page", "most", "author", "box", "top", "head", "slot", "de"])


def _zone(features: Container[str]) -> str:
    if not _OUTSIDE.isdisjoint(features):
        return "outside"
    return "silent" if _INSIDE.isdisjoint(features) else "inside"


#: A character of private use that marks blocks of main text in labelled pages.
MARK = "\ue000"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Pages of usual layouts in which the blocks of main text begin with MARK."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(1, 9)))

    def sentence(lo: int, hi: int) -> str:
        text = " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize()
        return text + rng.choice([".", ".", ".", "", "!", " |"])

    def words(lo: int = 1, hi: int = 60) -> str:
        return " ".join(sentence(1, 14) for _ in range(rng.randint(1, max(1, hi // 10)))) if hi > 14 else sentence(lo, hi)

    link = lambda: f'<a href="/{word()}">{sentence(1, 4)}</a>'
    items = lambda k: "".join(f"<li>{link()}</li>" for _ in range(k))

    def named(kind: str, element: str = "div") -> tuple[str, str]:
        name = rng.choice(_REST_NAMES[kind])
        if bare:
            return rng.choice([f"<{element}>", f'<{element} class="{word()}">']), f"</{element}>"
        return f'<{element} {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " " + word()])}">', f"</{element}>"

    def wrapped(inner: str, often: float) -> str:
        """In containers without a meaning, mostly a few, now and then many."""
        if rng.random() < often:
            for _ in range(rng.choice([1, 1, 1, 2, 2, 3, 4, 7, 30])):
                element = rng.choice(["div", "div", "div", "section"])
                named_so = f' {rng.choice(["class", "class", "id"])}="{rng.choice([*_PLAIN_NAMES, word()])}"' if rng.random() < 0.4 else ""
                inner = f"<{element}{named_so}>{inner}</{element}>"
        return inner

    def rest(kind: str) -> str:
        return wrapped(rest_part(kind), 0.3)

    def rest_part(kind: str) -> str:
        semantic = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside"}.get(kind)
        if semantic and rng.random() < (0.25 if bare else 0.6):
            a, b = (f"<{semantic}>", f"</{semantic}>") if rng.random() < 0.6 else named(kind, semantic)
        else:
            a, b = named(kind, rng.choice(["div", "div", "section", "p" if kind in ("advert", "notice") else "div"]))
        if kind == "menu":
            inner = f"<ul>{items(rng.randint(2, 8))}</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randint(2, 6)))
        elif kind == "head" and bare:
            inner = rng.choice([f"<a href='/'>{sentence(1, 3)}</a>", f"<div>{link()}</div>"])
        elif kind == "foot" and bare:
            inner = rng.choice([f"&copy; {word()} {words(1, 40)}", f"<p>© {sentence(1, 5)} {link()} {link()}</p>", f"<ul>{items(3)}</ul>", f"<p>&copy; {words(1, 20)}</p><p>{link()} {link()}</p>"])
        elif kind == "head":
            inner = rng.choice([f"<h1>{sentence(1, 5)}</h1>", f"<a href='/'>{sentence(1, 3)}</a>", f"<div>{sentence(1, 6)}</div><p>{sentence(2, 9)}</p>"])
        elif kind == "foot":
            inner = rng.choice([f"&copy; {word()} {words(1, 40)}", f"<p>© {sentence(1, 5)}</p>", words(1, 50), f"<ul>{items(3)}</ul><p>{words(1, 30)}</p>", f"&copy; {word()}.example.com &middot; {words(1, 40)}"])
        elif kind == "side" and bare:
            inner = f"<h3>{sentence(1, 4)}</h3><ul>{items(rng.randint(2, 6))}</ul>"
        elif kind == "side":
            inner = rng.choice([f"<h3>{sentence(1, 4)}</h3><ul>{items(rng.randint(2, 6))}</ul>", f"<h2>{sentence(1, 4)}</h2><p>{words(3, 50)}</p>", f"<p>{words(3, 60)}</p>", items(3)])
        elif kind == "form":
            inner = f"<form><label>{sentence(1, 3)}</label><input><button>{word()}</button>{rng.choice(['', '<p>' + words(2, 30) + '</p>', '<select><option>' + word() + '</option></select>'])}</form>"
        elif kind == "comment":
            one = lambda: rng.choice(
                [f"<div class='comment'><b>{word()}</b><p>{words(3, 60)}</p></div>", f"<li class='comment'><p>{words(3, 60)}</p></li>", f"<article class='comment'><p>{words(3, 60)}</p></article>", f"<p>{words(3, 60)}</p>", f"<blockquote>{words(3, 40)}</blockquote>"]
            )
            size = rng.randint(2, 4)
            inner = rng.choice(["", f"<h{size}>{sentence(1, 3)}</h{size}>", f"<h{size}>{rng.randint(1, 99)} {sentence(1, 3)}</h{size}>"]) + "".join(wrapped(one(), 0.2) for _ in range(rng.randint(1, 4)))
        else:
            inner = rng.choice([words(2, 40), words(2, 40), f"<p>{words(2, 40)}</p>", link(), f"<span>{words(2, 20)}</span> {link()}"])
        return a + wrapped(inner, 0.3) + b

    def main_block() -> str:
        if rng.random() < 0.05:  # sources, or what else an article links to
            links = "".join(f"<li>{MARK}{link()}{rng.choice(['', ' ' + words(1, 9)])}</li>" for _ in range(rng.randint(1, 5)))
            return f"<h3>{MARK}{sentence(1, 3)}</h3><ul>{links}</ul>" if rng.random() < 0.7 else f"<ul>{links}</ul>"
        text = MARK + words(1, rng.choice([3, 30, 60, 90]))
        if rng.random() < 0.25:
            text += f" <a href='#'>{sentence(1, 3)}</a> " + words(1, 20)
        form = rng.random()
        if form < 0.72:
            return rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text}</em></p>"])
        if form < 0.8:
            return f"<h{rng.randint(2, 4)}>{MARK}{sentence(1, 7)}</h{2}>"
        if form < 0.88:
            return "<ul>" + "".join(f"<li>{MARK}{words(1, 20)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if form < 0.94:
            return f"<blockquote><p>{text}</p></blockquote>"
        return rng.choice([f"<div>{text}</div>", f"<pre>{text}</pre>", f"<table><tr><td>{MARK}{word()}</td><td>{MARK}{word()}</td></tr></table>"])

    pages = []
    for _ in range(n):
        bare = rng.random() < 0.33  # nothing in it has a name that says what it is
        flow = rng.random()
        if rng.random() < 0.02:  # nothing but signs
            pages.append(rng.choice(["<", "-", "...", "|", "<p>*</p>", "<div>|</div>", "<div>&gt;</div>"]))
            continue
        if flow < 0.02:  # no markup at all
            pages.append(MARK + " \n\n".join(words(10, 90) for _ in range(rng.randint(1, 6))))
            continue
        body = [wrapped(main_block(), 0.08) for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 4, 6, 9, 14]))]
        if rng.random() < (0.45 if bare else 0.2):  # a page without paragraph elements
            body = [block.replace("<p>", "<div>").replace("</p>", "</div>") for block in body]
        running = flow < (0.35 if bare else 0.08)
        if running:  # text in its container itself, with breaks
            a, b = rng.choice([("", ""), ("<span>", "</span>"), ("<font>", "</font>")])
            body = [MARK + f"<br>{rng.choice(['', '<br>'])}".join(f"{a}{words(10, 90)}{b}" for _ in range(rng.randint(1, 6)))]
        if rng.random() < (0.35 if running else 0.7) or not body:
            body.insert(0, f"<h1>{MARK}{sentence(1, 9)}</h1>")
        for kind in [] if bare else rng.choices(["advert", "side", "notice", "form", "comment", "menu"], k=rng.choice([0, 0, 0, 1, 1, 2])):
            body.insert(rng.randint(1, len(body)) if kind != "comment" else len(body), rest(kind))
        inner = wrapped("".join(body), 0.45)
        layout = rng.random() if not bare else rng.choice([0.1, 0.9, 0.9, 0.9])
        if layout < 0.4:
            open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<article class="{rng.choice(_MAIN_NAMES)}">', "</article>"), ('<div role="main">', "</div>")])
        elif layout < 0.72:
            a = f'<div {rng.choice(["class", "id"])}="{rng.choice(_MAIN_NAMES)}">'
            open_, close = rng.choice([(a, "</div>"), (f'<div id="page">{a}', "</div></div>"), (f'<section class="{rng.choice(_MAIN_NAMES)}">', "</section>")])
        elif layout < 0.8:
            open_, close = f'<table><tr><td class="{rng.choice(_REST_NAMES["side"])}">{items(4)}</td><td class="{rng.choice(_MAIN_NAMES)}">', "</td></tr></table>"
        else:
            open_, close = rng.choice([("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<section>", "</section>")])
        before = [rest(k) for k in (("head", "menu", "form") if bare else ("notice", "head", "menu", "form", "advert", "side")) if rng.random() < (0.7 if k == "menu" else 0.35)]
        after = [rest(k) for k in (("side", "form", "foot") if bare else ("comment", "side", "advert", "form", "notice", "foot")) if rng.random() < (0.85 if k == "foot" else 0.3)]
        if rng.random() < 0.35:  # a page of little but its article
            before, after = before[: rng.choice([0, 0, 0, 1])], after[: rng.choice([0, 1])]
        head = f"<!DOCTYPE html><html><head><title>{sentence(1, 6)}</title><style>p{{}}</style></head><body>"
        head = head if rng.random() < 0.9 else ""
        wrap = rng.choice([("", ""), ("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page" class="site container">', "</div>")])
        middle = wrapped(open_ + inner + close, 0.35)
        pages.append(head + wrap[0] + "".join(before) + middle + "".join(after) + wrap[1] + rng.choice(["</body></html>", ""]))
    return pages


def labelled_blocks(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks and labels of a page marked as by `labelled_pages`, without the marks."""
    labels = [b.text.startswith(MARK) for b in leaf_blocks(page)]
    return leaf_blocks(page.replace(MARK, "")), labels


@functools.lru_cache(maxsize=4)
def trained(n_pages: int = 1_600, seed: int = 11) -> TaggerModel:
    """The model of so many generated pages."""
    pages = [labelled_blocks(html) for html in labelled_pages(n_pages, seed)]
    return fit([(blocks, labels) for blocks, labels in pages if len(blocks) == len(labels)])


def extracted(pages: DataFrame, model: TaggerModel | None = None, html: str = "html") -> DataFrame:
    """`pages` without the column html, with text (string) and n_chars (long) of each row's whole page.

    White space inside a block is one space, blocks are joined by one. A null or empty
    page, and one without main text, has the empty text. Columns called text and n_chars
    are replaced; all others, null ids and repeated rows pass as they are.
    """
    model = model or trained()
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    frame = pages.select([F.col(f"`{c}`") for c in names] + [F.col(f"`{html}`").alias("_html")])
    schema = StructType([*frame.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(page.as_py()) for page in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return frame.mapInArrow(run, schema)

"""A page as a tree of blocks, and a tree-structured model of which are content.

Every block element is a variable, content or not. What an element shows of
itself gives its own odds; a potential on each edge says how parent and child go
together. Sum-product messages, once upwards and once downwards, give every
element's marginal given the whole page.
"""

import math
import re

import numpy as np

from rankframe.functions.html_scan import END, ENDS_ITSELF, ENDS_PARAGRAPH, RAW, START, VOID, attributes, scan

BLOCKS = ENDS_PARAGRAPH | ENDS_ITSELF | frozenset(
    "html head body address caption tbody thead tfoot colgroup legend select button center".split()
)
# Elements told apart by name, and words told apart in class, id and role.
TAGS = (
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption "
    "nav header footer aside form fieldset button select address details hr"
).split()
WORDS = (
    "ad ads advert advertisement article author banner blog body bottom breadcrumb breadcrumbs button byline comment comments consent "
    "content contentinfo cookie copyright disclaimer discussion entry feedback footer form header legal links list login main masthead menu "
    "meta nav navbar navigation newsletter notice notification page pagination paging post privacy promo promotion recommended related "
    "replies reply respond responses search share sharing side sidebar signup site social sponsor sponsored story subscribe tags teaser text "
    "toolbar top trending warning widget wrap wrapper"
).split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_WORD = {w: len(TAGS) + i for i, w in enumerate(WORDS)}
_PLAIN = len(TAGS) + len(WORDS)
SIZE = _PLAIN + 10
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_SENTENCE = tuple(".!?…:;\"”»)")


class Tree:
    """Elements in page order (a parent before its children), and text blocks."""

    def __init__(self, page: str):
        self.tags, self.parents, self.raws = ["#page"], [-1], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        open_, count = [0], {}
        said: list[str] = []
        linked, skip, in_link = [0], "", False

        def flush() -> None:
            text = " ".join("".join(said).split())
            if text:
                self.blocks.append((open_[-1], text, min(linked[0], len(text))))
            said.clear()
            linked[0] = 0

        def close() -> None:
            tag = self.tags[open_.pop()]
            count[tag] -= 1

        for kind, tag, raw in scan(page):
            if kind == START:
                if tag in RAW:
                    skip = tag
                elif tag == "a":
                    in_link = True
                elif tag == "br":
                    said.append(" ")
                elif tag in BLOCKS:
                    flush()
                    if self.tags[open_[-1]] == "p" and (tag in ENDS_PARAGRAPH or tag in ENDS_ITSELF):
                        close()
                    if tag in ENDS_ITSELF and self.tags[open_[-1]] == tag:
                        close()
                    self.tags.append(tag)
                    self.parents.append(open_[-1])
                    self.raws.append(raw)
                    if tag not in VOID:
                        open_.append(len(self.tags) - 1)
                        count[tag] = count.get(tag, 0) + 1
                        in_link = in_link and tag != "body"
            elif kind == END:
                if tag in RAW:
                    skip = ""
                elif tag == "a":
                    in_link = False
                elif tag in BLOCKS:
                    flush()
                    if count.get(tag):
                        while self.tags[open_[-1]] != tag:
                            close()
                        close()
            elif not skip:
                said.append(tag)
                if in_link:
                    linked[0] += len(tag)
        flush()

    def features(self) -> np.ndarray:
        """One row per element: its name, its words, and what its text is like."""
        n = len(self.tags)
        sums = np.zeros((n, 5))  # characters, in links, blocks, words, blocks that end like a sentence
        first = np.full(n, -1.0)
        for at, (node, text, linked) in enumerate(self.blocks):
            sums[node] += (len(text), linked, 1, text.count(" ") + 1, text.endswith(_SENTENCE))
            if first[node] < 0:
                first[node] = at
        own = sums.copy()
        depth = np.zeros(n)
        for v in range(n - 1, 0, -1):
            p = self.parents[v]
            sums[p] += sums[v]
            if first[v] >= 0 and (first[p] < 0 or first[v] < first[p]):
                first[p] = first[v]
        for v in range(1, n):
            depth[v] = depth[self.parents[v]] + 1
        out = np.zeros((n, SIZE))
        for v in range(n):
            tag = _TAG.get(self.tags[v])
            if tag is not None:
                out[v, tag] = 1
            raw = self.raws[v]
            if raw and "=" in raw:
                found = attributes(raw)
                for name in ("class", "id", "role"):
                    for word in _SPLIT.split(found.get(name, "").lower()):
                        at = _WORD.get(word)
                        if at is not None:
                            out[v, at] = 1
                if "hidden" in found or "none" in found.get("style", ""):
                    out[v, _PLAIN] = 1
        chars, linked, blocks, words, ended = sums.T
        per = np.maximum(blocks, 1)
        out[:, _PLAIN + 1] = np.log1p(chars) / 5
        out[:, _PLAIN + 2] = linked / np.maximum(chars, 1)
        out[:, _PLAIN + 3] = np.log1p(words / per) / 3
        out[:, _PLAIN + 4] = ended / per
        out[:, _PLAIN + 5] = np.log1p(blocks) / 3
        out[:, _PLAIN + 6] = chars / max(chars[0], 1)
        out[:, _PLAIN + 7] = np.maximum(first, 0) / max(len(self.blocks), 1)
        out[:, _PLAIN + 8] = own[:, 0] > 0
        out[:, _PLAIN + 9] = 1
        return out


def _through(odds: float, from_no: tuple[float, float], from_yes: tuple[float, float]) -> float:
    """The log odds that a variable of these log odds passes over an edge."""
    yes = 1 / (1 + math.exp(-min(max(odds, -500.0), 500.0)))
    return math.log((from_no[1] * (1 - yes) + from_yes[1] * yes) / (from_no[0] * (1 - yes) + from_yes[0] * yes))


class Model:
    """``weights`` give an element's own log odds; ``edge[p][c]`` is the potential
    of a parent that is content or not (p) with a child that is or not (c)."""

    def __init__(self, weights: np.ndarray, edge: list[list[float]]):
        self.weights, self.edge = weights, edge

    def marginals(self, tree: Tree) -> np.ndarray:
        """Log odds of each element being content, given the page."""
        (a, b), (c, d) = self.edge
        up = (tree.features() @ self.weights).tolist()
        parents, sent = tree.parents, [0.0] * len(up)
        for v in range(len(up) - 1, 0, -1):
            sent[v] = _through(up[v], (a, c), (b, d))
            up[parents[v]] += sent[v]
        total = up
        for v in range(1, len(up)):
            total[v] += _through(total[parents[v]] - sent[v], (a, b), (c, d))
        return np.array(total)

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        tree = Tree(page)
        if not tree.blocks:
            return ""
        odds = self.marginals(tree)
        return "\n\n".join(text for node, text, _ in tree.blocks if odds[node] > 0)


def fitted(trees: list[Tree], labels: list[np.ndarray], ridge: float = 1.0, rounds: int = 10) -> Model:
    """Logistic weights by Newton steps, and edge potentials by counting: how
    much likelier a pair is than its two labels alone would make it."""
    x = np.concatenate([t.features() for t in trees])
    y = np.concatenate(labels).astype(float)
    w = np.zeros(SIZE)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(SIZE)
        w -= np.linalg.solve(hessian, gradient)
    counts = np.ones((2, 2))
    for t, label in zip(trees, labels):
        child = np.asarray(label, int)[1:]
        np.add.at(counts, (np.asarray(label, int)[np.array(t.parents[1:])], child), 1)
    joint = counts / counts.sum()
    edge = joint / np.outer(joint.sum(1), joint.sum(0))
    return Model(w, edge.tolist())

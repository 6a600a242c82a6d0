"""A page of HTML as a run of start tags, end tags and texts, read once, forwards.

Whatever is left open at the end of the page (a comment, a quoted value, the text
of a script) ends there, so a page is read in time proportional to its length
however broken it is.
"""

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
# A p ends where one of these starts.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
# These end where another of the same kind starts.
ENDS_ITSELF = frozenset("li dt dd option tr td th".split())
START, END, TEXT = "start", "end", "text"
# Tags remembered, and how long one of them may be.
KNOWN_TAGS, SHORT_TAG = 8192, 120

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# Text and the tag after it, as nearly all tags are written: values in double quotes, or no quotes at all.
PLAIN_TAG = re.compile(
    r"""([^<]*)<(/?[a-zA-Z][^\s/>]*(?=[\s/>])(?:(?:[^>"'=]*[^\s>"'=/]="[^"]*")*[^>"'=]*|[^>"']*))>"""
)
# Text and what stands between the signs of the tag after it, where no value holds such a sign; anything else is one character.
TAG = re.compile(r"(?s)([^<]*)<(/?[a-zA-Z][^>]*)>|.")
_PLAIN_HEAD = re.compile(r"""/?[a-zA-Z][^\s/>]*(?![^\s/])(?:(?:[^>"'=]*[^\s>"'=/]="[^"]*")*[^>"'=]*|[^>"']*)""")
_HEAD = re.compile(r"(?s)(/?)([^\s/>]*)(.*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}


def plain(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), plain(double or single or bare))
    return found


_known = lru_cache(maxsize=KNOWN_TAGS)(_attributes)


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a start tag; the first of a name counts. Pages say the
    same short tags over and over, so those are read once; not to be changed."""
    return _known(raw) if len(raw) <= SHORT_TAG else _attributes(raw)


def _tag_end(page: str, at: int) -> tuple[int, str]:
    """Where the tag whose name ends at ``at`` ends, and its attributes as written."""
    close = page.find(">", at)
    if close < 0:
        return len(page), page[at:]
    raw = page[at:close]
    if '"' not in raw and "'" not in raw:
        return close + 1, raw
    place = at
    while found := _ATTRIBUTE.match(page, place):
        # An equals sign with nothing in front of it is passed over.
        place = found.end()
        while page[place : place + 1] == "=":
            place += 1
    close = page.find(">", place)
    if close < 0:
        return len(page), page[at:]
    return close + 1, page[at:close]


def parts_of(head: str) -> tuple[str, str, str]:
    """What stands between the signs of a tag: a slash where it is an end tag, the name, the attributes as written."""
    closing, tag, raw = _HEAD.match(head).groups()
    return closing, tag.lower(), raw


def is_plain(head: str) -> bool:
    """Whether what ``TAG`` found between the signs of a tag is all of the tag."""
    return _PLAIN_HEAD.fullmatch(head) is not None


def read_attributes(raw: str) -> dict[str, str]:
    """As ``attributes``, not remembered: for who remembers whole tags."""
    return _attributes(raw)


def odd(page: str, place: int, text_from: int) -> tuple[str, str, int, int]:
    """What stands where no tag is plainly written: the text up to a tag, what stands
    between the tag's signs ("" for a comment, a bare sign and the end of the page),
    and the places from which to go on and from which text goes on."""
    at = page.find("<", place)
    if at < 0:
        return "", "", len(page), text_from
    named = _NAME.match(page, at)
    if named is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
        return "", "", at + 1, text_from  # a bare sign is text
    text = page[text_from:at]
    if named is None:
        comment = page.startswith("<!--", at)
        close = page.find("-->" if comment else ">", at + 4 if comment else at)
        place = len(page) if close < 0 else close + (3 if comment else 1)
        return text, "", place, place
    place, raw = _tag_end(page, named.end())
    return text, "".join(named.groups()) + raw, place, place


def raw_text(page: str, tag: str, place: int) -> tuple[str, int]:
    """The content of an element that holds text alone, and where its end tag ends."""
    close = _CLOSE[tag].search(page, place)
    return (page[place : close.start()], close.end()) if close else (page[place:], len(page))


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(START, tag, attributes as written), (END, tag, "") and (TEXT, text, "");
    texts are decoded, except for those of scripts and their like."""
    size, place, text_from = len(page), 0, 0
    while place < size:
        found = PLAIN_TAG.match(page, place)
        if found is not None:
            text, head = found.groups()
            if text_from < place:
                text = page[text_from : found.end(1)]
            place = text_from = found.end()
        else:
            text, head, place, text_from = odd(page, place, text_from)
        if text:
            yield TEXT, plain(text), ""
        if not head:
            continue
        closing, tag, raw = parts_of(head)
        if closing:
            yield END, tag, ""
            continue
        yield START, tag, raw
        if tag in RAW:
            text, place = raw_text(page, tag, place)
            text_from = place
            if text:
                yield TEXT, text, ""
            yield END, tag, ""
    if text_from < size:
        yield TEXT, plain(page[text_from:]), ""

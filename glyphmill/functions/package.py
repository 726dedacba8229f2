"""Package documents and tables of contents: converted fields, direction of pages, links and items taken out.

Documents are read as tokens, so comments, CDATA, prefixes and nested elements are what they are, and whatever is not
changed comes out as it was, byte for byte.
"""

from __future__ import annotations

import posixpath
import re
from collections import Counter
from collections.abc import Callable
from html import escape, unescape
from urllib.parse import unquote

from glyphmill.functions.markup import tokens

#: Fields of a package's metadata that are converted, beside its creators.
FIELDS = ("title", "description", "publisher", "subject", "contributor", "coverage", "rights")
_FILE_AS = re.compile(r"""((?:[\w.-]+:)?file-as\s*=\s*)(["'])(.*?)\2""")
_PROGRESSION = re.compile(r"""\s+page-progression-direction\s*=\s*(?:"[^"]*"|'[^']*')""")
_KIND = re.compile(r"""\btype\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_WRITING_MODE = re.compile(r"""\bname\s*=\s*["']primary-writing-mode["']""")

Convert = Callable[[str], str]


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def rewritten(xml: str, chosen: Callable[[str, str, Counter], Convert | None], tag: Callable[[str, str, Counter], str] = lambda name, raw, opened: raw) -> str:
    """A document with the text of chosen elements converted and start tags rewritten.

    chosen(name, start tag, open elements by name) gives what converts an element's text, that of its children too, or
    None; names are without prefix. Text between two tags is converted at once, entities and CDATA with it.
    """
    out: list[str] = []
    run: list[tuple[str, str, str]] = []
    opened: Counter = Counter()
    stack: list[tuple[str, Convert | None]] = [("", None)]

    def flush() -> None:
        plain = "".join(name if kind == "cdata" else unescape(raw) for kind, name, raw in run)
        new = plain if plain.isspace() or not run else stack[-1][1](plain)
        out.extend([escape(new, quote=False)] if new != plain else [raw for _, _, raw in run])
        run.clear()

    for kind, name, raw in tokens(xml, xml=True):
        if stack[-1][1] and kind in ("text", "entity", "cdata"):
            run.append((kind, name, raw))
            continue
        flush()
        if kind in ("start", "empty"):
            own = _local(name)
            out.append(tag(own, raw, opened))
            if kind == "start":
                stack.append((own, chosen(own, raw, opened) or stack[-1][1]))
                opened[own] += 1
            continue
        if kind == "end" and opened[_local(name)]:
            while True:
                own = stack.pop()[0]
                opened[own] -= 1
                if own == _local(name):
                    break
        out.append(raw)
    flush()
    return "".join(out)


def converted_metadata(opf: str, convert: Convert, language: str | None = None) -> str:
    """A package document with its fields converted: text, creators' sorted names, and a Chinese language by its new tag.

    Identifiers, roles, dates and whatever else there is stay as they are.
    """
    retag = lambda text: language if "zh" in text.lower() else text

    def chosen(name: str, raw: str, opened: Counter) -> Convert | None:
        if not opened["metadata"]:
            return None
        return convert if name in (*FIELDS, "creator") else retag if name == "language" and language else None

    def tag(name: str, raw: str, opened: Counter) -> str:
        if name != "creator" or not opened["metadata"]:
            return raw
        return _FILE_AS.sub(lambda a: f"{a[1]}{a[2]}{escape(convert(unescape(a[3])))}{a[2]}", raw)

    return rewritten(opf, chosen, tag)


def converted_contents(toc: str, convert: Convert) -> str:
    """A table of contents with the titles of its entries converted: text of an NCX, links and spans of a toc's nav."""

    def chosen(name: str, raw: str, opened: Counter) -> Convert | None:
        if name == "text" and opened["navMap"]:
            return convert
        if name == "nav":
            found = _KIND.search(raw)
            opened["toc in nav"] = bool(found and "toc" in (found[1] or found[2] or "").split())
        return convert if name in ("a", "span") and opened["nav"] and opened["toc in nav"] else None

    return rewritten(toc, chosen)


def with_progression(opf: str, orientation: int) -> str:
    """The spine's page direction: rtl for vertical (2), ltr for horizontal (1), default else."""
    flow = {1: "ltr", 2: "rtl"}.get(orientation, "default")

    def tag(name: str, raw: str, opened: Counter) -> str:
        if name != "spine":
            return raw
        bare = _PROGRESSION.sub("", raw)
        end = -2 if bare.endswith("/>") else -1
        return f'{bare[:end].rstrip()} page-progression-direction="{flow}"{bare[end:]}'

    return rewritten(opf, lambda *_: None, tag)


def with_writing_mode(opf: str, orientation: int) -> str:
    """The meta element of a converted book's writing mode, changed or added at the end of the metadata."""
    mode = {1: "horizontal-lr", 2: "vertical-rl"}[orientation]
    meta = f'<meta name="primary-writing-mode" content="{mode}"/>'
    out, there = [], False
    for kind, name, raw in tokens(opf, xml=True):
        if kind in ("start", "empty") and _local(name) == "meta" and _WRITING_MODE.search(raw):
            raw, there = meta if kind == "empty" else f"{meta[:-2]}>", True
        out.append((kind == "end" and _local(name) == "metadata", raw))
    at = next((i for i, (ends, _) in enumerate(out) if ends), None)
    pieces = [raw for _, raw in out]
    if not there and at is not None:
        pieces.insert(at, meta)
    return "".join(pieces)


def resolved(part_name: str, link: str, names: frozenset[str] | set[str] | None = None) -> str | None:
    """The part that a link of a part points to: relative to it, else as written; None for data and for no such part."""
    bare = unquote((link or "").strip().split("#", 1)[0].split("?", 1)[0])
    if not bare or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", bare):
        return None
    near = posixpath.normpath(posixpath.join(posixpath.dirname(part_name), bare))
    if names is None:
        return near
    return near if near in names else bare if bare in names else None


_TARGET = re.compile(r"""(?i)\b(?:src|href|xlink:href)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_URL = re.compile(r"""(?i)url\(\s*(["']?)([^"')]*)\1\s*\)""")
_IMAGES, _ITEMS = ("img", "image"), ("link", "item")


def _target(raw: str) -> str | None:
    found = _TARGET.search(raw)
    return unescape(found[1] or found[2] or "") if found else None


def without_urls(css: str, part_name: str, gone: frozenset[str]) -> str:
    """Style text without declarations that name a part that is gone."""
    pieces = re.split("([;{}])", css)
    for i in range(0, len(pieces), 2):
        if ":" in pieces[i] and any(resolved(part_name, u[1]) in gone for u in _URL.findall(pieces[i])):
            pieces[i] = pieces[i][: len(pieces[i]) - len(pieces[i].lstrip())]
            if pieces[i + 1 : i + 2] == [";"]:
                pieces[i + 1] = ""
    return "".join(pieces)


def without_links(text: str, part_name: str, gone: frozenset[str]) -> str:
    """Markup, package or style text without what points to parts that are gone.

    Images, links and manifest items go, with an end tag that follows at once; anchors leave what they hold; declarations
    of styles with such a url go.
    """
    if part_name.lower().endswith(".css"):
        return without_urls(text, part_name, gone)
    out: list[str] = []
    anchors: list[bool] = []  # whether an open anchor goes
    ending = ""  # the element whose end tag goes if it comes now
    for kind, name, raw in tokens(text):
        own, was, ending = _local(name), ending, ending if kind == "text" and raw.isspace() else ""
        dead = kind in ("start", "empty") and own in (*_IMAGES, *_ITEMS, "a") and resolved(part_name, _target(raw) or "") in gone
        if kind == "start" and own == "a":
            anchors.append(dead)
        elif kind == "end" and own == "a" and anchors:
            dead = anchors.pop()
        elif dead and kind == "start":
            ending = own
        elif kind == "end" and own == was:
            dead = True
        elif kind == "opaque" and own == "style":
            raw = without_urls(raw, part_name, gone)
        if not dead:
            out.append(raw)
    return "".join(out)


def links(text: str, part_name: str) -> set[str]:
    """The parts that a part points to: of images, links, manifest items, anchors and style urls."""
    found = {resolved(part_name, u[1]) for u in _URL.findall(text)} if "url(" in text.lower() else set()
    if not part_name.lower().endswith(".css"):
        for kind, name, raw in tokens(text):
            if kind in ("start", "empty") and _local(name) in (*_IMAGES, *_ITEMS, "a"):
                found.add(resolved(part_name, _target(raw) or ""))
    return {x for x in found if x}


def image_links(html: str) -> list[tuple[int, str, str]]:
    """(place, tag, link) of every image of a part."""
    found, at = [], 0
    for kind, name, raw in tokens(html):
        if kind in ("start", "empty") and _local(name) in _IMAGES and (link := _target(raw)) is not None:
            found.append((at, raw, link))
        at += len(raw)
    return found


def with_label(tag: str, text: str) -> str:
    """An image's tag with a text in its place: alt for img, else aria-label; replaced or added, escaped."""
    name, value = ("alt" if tag.lstrip().lower().startswith("<img") else "aria-label"), escape(text, quote=True)
    own = re.compile(rf"""(?is)\b{name}\s*=\s*(?:"[^"]*"|'[^']*')""")
    if own.search(tag):
        return own.sub(lambda _: f'{name}="{value}"', tag, count=1)
    end = -2 if tag.endswith("/>") else -1
    return f'{tag[:end]} {name}="{value}"{tag[end:]}' if tag.endswith(">") else tag


def labelled(html: str, part_name: str, texts: dict[str, str]) -> str:
    """A part whose images carry the texts recognized in them, by part name."""
    names, out = frozenset(texts), []
    for kind, name, raw in tokens(html):
        if kind in ("start", "empty") and _local(name) in _IMAGES and (link := _target(raw)) is not None:
            part = resolved(part_name, link, names)
            raw = with_label(raw, texts[part]) if part and texts[part] else raw
        out.append(raw)
    return "".join(out)

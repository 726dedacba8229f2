"""Markup of book parts: tokens, conversion of text nodes, and annotated (bilingual) rendering."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html import escape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column

from glyphmill.functions.batches import Remembered, per_text, text_fields
from glyphmill.functions.rewrite import Runner, aligned
from glyphmill.functions.text import CORNER_QUOTES, CURLY_QUOTES, HORIZONTAL, NOT_CHINESE, USUAL_OMITS, VERTICAL
from glyphmill.plans.program import NO_CONVERSION, Program

#: Comments around a selection, the class of converted bodies, classes and style of annotated text.
SELECTION_START, SELECTION_END = "PI_SELTEXT_START", "PI_SELTEXT_END"
BODY_CLASS = "calibre-chinese_text"
ANNOTATION_STYLE_ID = "ctc-bi-annotation-style"
ANNOTATION_RULES = {
    ".ctc-bi": "ruby-position:under;ruby-align:center",
    ".ctc-bi-main": "line-height:inherit",
    ".ctc-bi-rt": "font-size:.75em;line-height:1;color:inherit;opacity:.55;padding-bottom:0.55em",
    ".ctc-bi-pair": "display:inline-block;vertical-align:baseline;text-align:center;max-width:100%;word-break:keep-all",
    ".ctc-bi-pair>.ctc-bi-main": "display:block;line-height:inherit",
    ".ctc-bi-pair>.ctc-bi-rt": "display:block;font-size:.75em;line-height:1;color:inherit;opacity:.55;padding-bottom:0.15em;word-break:keep-all",
}
FONT_STYLE_ID = "ctc-cjk-font-style"

#: The beginning of every kind of token; together the alternatives begin any text.
_OPEN = re.compile(
    r"""(?P<text>[^<&]+)|&(?P<entity>\#[0-9]+|\#[xX][0-9A-Fa-f]+|[A-Za-z][-.A-Za-z0-9]*);?
    |<(?:(?P<comment>!--)|(?P<declaration>!)|(?P<instruction>\?)|/(?P<end>[A-Za-z])|(?P<start>[A-Za-z]))|(?P<stray>[<&])""",
    re.VERBOSE,
)
_START = re.compile(r"""<([A-Za-z][^\s/>]*+)(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_COMMENT_END, _NAME_END, _SPECIAL = re.compile("--!?>"), re.compile(r"[\s/>]|\Z"), re.compile("""[>"']""")
_OPAQUE = {tag: re.compile(rf"(?i)</{tag}(?=[\s/>])|\Z") for tag in ("style", "script")}
_FOREIGN = re.compile("(?i)lang=\"(?:" + "|".join(NOT_CHINESE) + ")")
_CHINESE = re.compile(r'(?i)lang="zh(?:-[-\w+]+)?"')
_CLASS = re.compile(r"""(class=)(["'])(.*?)\2""")


class _Ahead:
    """What closes tags and comments further on in a text, found once: places are asked for from left to right."""

    def __init__(self, html: str):
        self.html, self.comments, self.cdata, self.last = html, True, True, html.rfind(">")
        self.name = (0, 0)
        self.special: list[int] | None = None
        self.quotes: dict[str, list[int]] = {}
        self.hopeless: set[int] = set()

    def comment(self, at: int) -> re.Match[str] | None:
        found = _COMMENT_END.search(self.html, at) if self.comments else None
        self.comments = found is not None
        return found

    def name_end(self, at: int) -> int:
        """End of a tag's name; names that begin within another have its end."""
        start, end = self.name
        if not start <= at < end:
            self.name = at, end = at, _NAME_END.search(self.html, at).start()
        return end

    def start_end(self, at: int) -> int:
        """End of the start tag at a place, outside of quotes; 0 without one."""
        if at > self.last:
            return 0
        if self.special is None:
            if found := _START.match(self.html, at):
                return found.end()
            self.special = [m.start() for m in _SPECIAL.finditer(self.html, at)]  # a tag has no end: look more closely from now on
            for i in self.special:
                self.quotes.setdefault(self.html[i], []).append(i)
        seen, place = [], self.name_end(at + 1)
        while True:
            k = bisect_left(self.special, place)
            if k in self.hopeless or k == len(self.special):
                break
            seen.append(k)
            if self.html[self.special[k]] == ">":
                return self.special[k] + 1
            same = self.quotes[self.html[self.special[k]]]
            close = bisect_right(same, self.special[k])
            if close == len(same):
                break
            place = same[close] + 1
        self.hopeless.update(seen)
        return 0


def tokens(html: str, xml: bool = False) -> Iterator[tuple[str, str, str]]:
    """(kind, name, raw) of a document, in order; raw joined is the document. Style and script hold one opaque token.

    xml: names keep their case, no element is opaque, and there are cdata tokens.

    Text takes time in proportion to its length, also where tags, comments or quotes never end: their openings are text.
    """
    at, size, ahead = 0, len(html), _Ahead(html)
    while at < size:
        found = _OPEN.match(html, at)
        kind, begun = found.lastgroup, found.end()
        if kind == "text" or kind == "entity":
            yield kind, found[kind], found[0]
            at = begun
            continue
        end = 0
        if xml and kind == "declaration" and ahead.cdata and html.startswith("<![CDATA[", at):
            ahead.cdata = (close := html.find("]]>", at + 9)) >= 0
            if ahead.cdata:
                yield "cdata", html[at + 9 : close], html[at : close + 3]
                at = close + 3
                continue
        if kind == "comment":
            if close := ahead.comment(begun):
                name, end = html[begun : close.start()], close.end()
            else:
                kind, begun = "declaration", at + 2
        if kind == "start":
            if end := ahead.start_end(at):
                name = html[at + 1 : ahead.name_end(at + 1)]
                name = name if xml else name.lower()
        elif kind not in ("comment", "stray") and begun <= ahead.last:
            end = html.index(">", begun) + 1
            name = html[at + 2 : ahead.name_end(at + 2)] if kind == "end" else html[begun : end - 1]
            name = name.lower() if kind == "end" and not xml else name
        if not end:
            yield "text", html[at], html[at]
            at += 1
            continue
        raw, at = html[at:end], end
        yield ("empty" if kind == "start" and raw.endswith("/>") else kind), name, raw
        if xml:
            continue
        if kind == "start" and name in _OPAQUE and not raw.endswith("/>"):
            end = _OPAQUE[name].search(html, at).start()
            if at < end:
                yield "opaque", name, html[at:end]
            at = end


# ---- annotated text --------------------------------------------------------------------------------------


def _valid(original: str, converted: str, spans: list[tuple] | None) -> list[tuple[str, str]] | None:
    """(source, target) of spans, if end to end they give the original and the converted text; else None."""
    if not spans:
        return None
    starts, ends, sources, targets = list(zip(*spans))[:4]
    bounds = list(accumulate(map(len, sources), initial=0))
    fits = [*starts] == bounds[:-1] and [*ends] == bounds[1:] and "".join(sources) == original and "".join(targets) == converted
    return list(zip(sources, targets)) if fits else None


def _annotated(source: str, target: str) -> str:
    """The target with its source below: as ruby, or as a stacked pair where their lengths differ."""
    above, below = escape(target, quote=False), escape(source, quote=False)
    if len(source) == len(target):
        return f'<ruby class="ctc-bi"><rb class="ctc-bi-main">{above}</rb><rt class="ctc-bi-rt">{below}</rt></ruby>'
    return f'<span class="ctc-bi ctc-bi-pair"><span class="ctc-bi-main">{above}</span><span class="ctc-bi-rt">{below}</span></span>'


def annotate(original: str, converted: str, spans: list[tuple] | None = None, mode: str = "full") -> str:
    """Converted text with its original below each segment: of all segments (full) or of changed ones (changed).

    Text that does not change is given back as it is, without escapes. Spans that do not fit are not used.
    """
    if original == converted:
        return original
    full = _full(mode)
    return "".join(_segment(*pair, full) for pair in _valid(original, converted, spans) or [(original, converted)])


def _full(mode: str | None) -> bool:
    return (mode or "full").strip().lower() != "changed"


def _segment(original: str, converted: str, full: bool) -> str:
    """One segment annotated."""
    out = []
    for source, target in aligned(original, converted) if original != converted else [(original, converted)]:
        if source and target and (full or source != target):
            out.append(_annotated(source, target))
        else:
            out.append(escape(source or target, quote=False))
    return "".join(out)


def annotator(runner: Runner, mode: str | None) -> Callable[[str], str]:
    """A function that annotates texts with their conversion; segments that come again are remembered where each is told by its characters."""
    letters = runner.letters
    if letters is None:

        def run(text: str) -> str:
            converted, spans = runner.run(text)
            return annotate(text, converted, spans, mode)

        return run
    full = _full(mode)
    known = Remembered(lambda s: _segment(s, s.translate(letters.table), full), lambda v: 60 + 2 * len(v))
    return lambda text: "".join(map(known.__getitem__, letters.runs.findall(text))) if letters.changed.search(text) else text


_CLASSES = re.compile(r"""(?i)\bclass\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_IDS = re.compile(r"""(?i)\bid\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _values(pattern: re.Pattern[str], raw: str) -> list[str]:
    found = pattern.search(raw)
    return (found[1] or found[2] or "").split() if found else []


def without_styles(found: Iterable[tuple[str, str, str]], ids: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """Tokens without style elements of the given ids and the white space that follows them."""
    inside = after = False
    for kind, name, raw in found:
        if not inside and kind == "start" and name == "style" and any(i in ids for i in _values(_IDS, raw)):
            inside = True
        elif inside:
            inside = not (kind == "end" and name == "style")
            after = True
        else:
            if after and kind == "text":
                raw = raw.lstrip()
            after = after and kind == "text" and not raw
            if raw:
                yield kind, name, raw


#: Pieces of text in order, nested.
Pieces = list


@dataclass
class _Open:
    """An element that is open: its tag, what it is of an annotation, its start tag, and its content so far.

    Content is (role, all of it, what it holds inside of its tags).
    """

    tag: str
    role: str
    raw: str
    content: list[tuple[str, Pieces, Pieces]]


_ROLES = {
    ("ruby", "ctc-bi"): "ruby", ("span", "ctc-bi-pair"): "pair", ("span", "ctc-bi"): "pair", ("rb", "ctc-bi-main"): "main",
    ("span", "ctc-bi-main"): "main", ("rt", "ctc-bi-rt"): "below", ("span", "ctc-bi-rt"): "below",
}
_TRACKED = frozenset(tag for tag, _ in _ROLES)


def _original(element: _Open) -> Pieces | None:
    """The original text of an annotation: main text, then the original, and nothing else; None for other elements."""
    if element.role not in ("ruby", "pair"):
        return None
    said = [part for part in element.content if part[0] != "text" or not all(isinstance(p, str) and p.isspace() for p in part[1])]
    roles = [part[0] for part in said]
    plain = element.role == "pair" and roles == ["text", "below"] and not any(isinstance(p, str) and p.startswith("<") for p in said[0][1])
    return said[-1][2] if plain or roles == ["main", "below"] else None


def _flat(pieces: Pieces) -> str:
    out, waiting = [], [iter(pieces)]
    while waiting:
        for piece in waiting[-1]:
            if isinstance(piece, list):
                waiting.append(iter(piece))
                break
            out.append(piece)
        else:
            waiting.pop()
    return "".join(out)


_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: Annotations and their style as they are written here, whose first two groups are the original text; else what tokens()
#: gives beside text, in group 3. From a tag or comment without an end on, all of the text is one match.
_SIMPLE = re.compile(
    r'''<ruby\ class="ctc-bi"><rb\ class="ctc-bi-main">[^<]*+</rb><rt\ class="ctc-bi-rt">([^<]*+)</rt></ruby>
    |<span\ class="ctc-bi\ ctc-bi-pair"><span\ class="ctc-bi-main">[^<]*+</span><span\ class="ctc-bi-rt">([^<]*+)</span></span>
    |<style\ type="text/css"\ id="'''
    + ANNOTATION_STYLE_ID
    + r'''">[^<]*+</style>\s*+
    |(<(?:!--(?s:.*?--!?>|.*)|(?:[!?]|/[A-Za-z])(?:[^>]*+>|(?s:.*))'''
    + "".join(rf"|(?i:{tag})(?=[\s/>]){_REST}(?:(?<=/>)|(?s:.*?)(?=(?i:</{tag})[\s/>]|\Z))" for tag in _OPAQUE)
    + rf"|[A-Za-z](?:[^\s/>]*+{_REST}|(?s:.*))))",
    re.VERBOSE,
)


def without_annotations(html: str) -> str:
    """Markup of earlier annotated conversions taken out, of all layers; the original text stays.

    Annotations of one layer as they are written here come off by one pattern. If anything of their classes is left then,
    the whole goes again, in one pass with a stack of open elements. An annotation is an element of its class that holds main
    text and original text in elements of theirs, and white space; everything else stays as it is, also what is not closed.
    """
    if "ctc-bi" not in html:
        return html
    simple = _SIMPLE.sub(r"\1\2\3", html)
    return _without_layers(html) if "ctc-bi" in simple else simple


def _without_layers(html: str) -> str:
    """The same of any annotations."""
    stack, opened = [_Open("", "", "", [])], Counter()

    def text(piece: str | Pieces) -> None:
        content = stack[-1].content
        if content and content[-1][0] == "text":
            content[-1][1].append(piece)
        else:
            content.append(("text", [piece], []))

    def leave(end: str | None) -> None:
        """Takes the top element off, closed by a tag or not at all."""
        element = stack.pop()
        opened[element.tag] -= 1
        inner = [whole for _, whole, _ in element.content]
        original = None if end is None else _original(element)
        if original is not None:
            text(original)
        elif end is not None and element.role in ("main", "below"):
            stack[-1].content.append((element.role, [element.raw, inner, end], inner))
        else:
            text([element.raw, inner, end or ""])

    for kind, name, raw in without_styles(tokens(html), (ANNOTATION_STYLE_ID,)):
        if kind == "start" and name in _TRACKED:
            roles = (_ROLES.get((name, c)) for c in sorted(_values(_CLASSES, raw), key=len, reverse=True)) if "ctc-bi" in raw else ()
            stack.append(_Open(name, next(filter(None, roles), ""), raw, []))
            opened[name] += 1
        elif kind == "end" and opened[name]:
            while stack[-1].tag != name:
                leave(None)
            leave(raw)
        else:
            text(raw)
    while len(stack) > 1:
        leave(None)
    return _flat([whole for _, whole, _ in stack[0].content])


# ---- conversion of a part --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Markup:
    """How a part is rewritten: styles of text, attributes, annotation, and what of it is converted.

    quotes and orientation as in functions.text.restyle; source: "book" or "file" (all of it) or "selection" (what
    stands between the selection comments); font_css: declarations of a style block for all text, if any; segmenter:
    what cuts the units of conversion, if not the program's own keys.
    """

    program: Program = NO_CONVERSION
    language: str | None = None
    quotes: int = 0
    orientation: int = 0
    punctuation: bool = False
    omits: str = USUAL_OMITS
    annotation: str | None = None
    source: str = "book"
    font_css: str | None = None
    segmenter: Callable[[str], list[str]] | None = None

    @property
    def converts(self) -> bool:
        p = self.program
        return bool(p.stages or p.normalize or p.chained or p.pivot or p.post)


def _restyler(m: Markup) -> Callable[[str], str]:
    """Quotes and punctuation of a text node; punctuation comes first where text becomes horizontal."""
    quotes = {1: str.maketrans(CORNER_QUOTES, CURLY_QUOTES), 2: str.maketrans(CURLY_QUOTES, CORNER_QUOTES)}.get(m.quotes, {})
    pairs = [(h, v) for h, v in zip(HORIZONTAL, VERTICAL) if h not in m.omits] if m.punctuation else []
    marks = {2: {ord(h): v for h, v in pairs}, 1: {ord(v): h for h, v in pairs}}.get(m.orientation, {})
    first, then = (marks, quotes) if m.orientation == 1 else (quotes, marks)
    return lambda text: text.translate(first).translate(then)


def with_body_class(tag: str) -> str:
    """A body's start tag with the class of converted text."""
    if BODY_CLASS in tag:
        return tag
    if _CLASS.search(tag):
        return _CLASS.sub(rf"\1\2\3 {BODY_CLASS}\2", tag, count=1)
    return tag[:5] + f' class="{BODY_CLASS}"' + tag[5:]


def rewriter(m: Markup) -> Callable[[str], str]:
    """A function that rewrites whole parts.

    Only text nodes are converted: never style or script, entities, comments or declarations. End tags come out in
    lower case and entities with their semicolon. Text between two tags or entities is one unit of conversion.
    """
    runner, restyle, annotates = Runner(m.program, m.segmenter), _restyler(m), bool(m.annotation) and m.converts
    annotated = annotator(runner, m.annotation)
    styles = []
    if annotates:
        styles.append(f'<style type="text/css" id="{ANNOTATION_STYLE_ID}">' + "".join(f"{k}{{{v}}}" for k, v in ANNOTATION_RULES.items()) + "</style>")
    if m.font_css:
        styles.append(f'<style type="text/css" id="{FONT_STYLE_ID}">body.{BODY_CLASS},body.{BODY_CLASS} *{{{m.font_css}}}</style>')

    def text_node(text: str, active: bool) -> str:
        if text.isspace() or not active:
            return text
        text = restyle(text)
        if not m.converts:
            return text
        return annotated(text) if annotates else runner.text(text)

    def tag_text(raw: str, active: bool) -> str:
        if not (active and m.converts and m.language) or _FOREIGN.search(raw):
            return raw
        return _CHINESE.sub(f'lang="{m.language}"', raw)

    def run(html: str) -> str:
        active, waiting, out = m.source != "selection", "".join(styles), []
        for kind, name, raw in without_styles(tokens(without_annotations(html)), (FONT_STYLE_ID,)):
            if kind == "text":
                out.append(text_node(raw, active))
            elif kind == "entity":
                out.append(f"&{name};")
            elif kind == "comment":
                if m.source == "selection" and name.strip() in (SELECTION_START, SELECTION_END):
                    active = name.strip() == SELECTION_START
                out.append(f"<!--{name}-->")
            elif kind == "end":
                if name == "head":
                    out.append(waiting)
                    waiting = ""
                out.append(f"</{name}>")
            elif kind == "start":
                if name == "body" and (styles or m.orientation):
                    out.append(waiting)
                    waiting, raw = "", with_body_class(raw)
                out.append(tag_text(raw, active))
            else:
                out.append(tag_text(raw, m.source == "book") if kind == "empty" else raw)
        return "".join(out)

    return run


def convert_markup(html: Column, m: Markup) -> Column:
    """Parts rewritten in an Arrow UDF; null stays null."""
    return per_text(lambda: rewriter(m), "string", pa.string())(html)


def strip_annotations(html: Column) -> Column:
    return per_text(lambda: without_annotations, "string", pa.string())(html)


def annotated_and_back(html: Column, m: Markup) -> Column:
    """struct<annotated, back>: the MD5 of parts rewritten by m, and these without annotations, in one Arrow UDF; null for null.

    An annotated part is some forty times as long as its text, so it stays in the worker that makes it.
    """

    def make() -> Callable[[str], tuple[str, str]]:
        run = rewriter(m)

        def each(part: str) -> tuple[str, str]:
            found = run(part)
            return hashlib.md5(found.encode(), usedforsecurity=False).hexdigest(), without_annotations(found)

        return each

    return per_text(make, *text_fields(("annotated", "back")))(html)


def token_array(html: Column) -> Column:
    """array<struct<kind, name, raw>>: a part's tokens in order; null for null."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "name", "raw")]))
    return per_text(lambda: lambda v: [dict(zip(("kind", "name", "raw"), t)) for t in tokens(v)], "array<struct<kind:string,name:string,raw:string>>", kind)(html)

"""Style sheets as text: rules found, put in or replaced, fonts named by them, and stacks of fonts for all text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from glyphmill.functions.markup import ANNOTATION_RULES, BODY_CLASS

#: Usual fonts of each system by policy, generic names, and hints of fonts made for simplified text.
FONTS = {
    "serif": {
        "win": ("SimSun", "NSimSun", "STSong", "SimSun-ExtB"),
        "mac": ("Songti SC", "Songti TC", "STSong", "LiSong Pro"),
        "linux": ("Noto Serif CJK SC", "Noto Serif CJK TC", "Noto Serif CJK HK", "Source Han Serif SC", "Source Han Serif TC", "AR PL UMing CN"),
    },
    "sans": {
        "win": ("Microsoft YaHei", "SimHei", "Microsoft JhengHei", "DengXian"),
        "mac": ("PingFang SC", "PingFang TC", "Heiti SC", "Heiti TC", "STHeiti"),
        "linux": ("Noto Sans CJK SC", "Noto Sans CJK TC", "Noto Sans CJK HK", "Source Han Sans SC", "Source Han Sans TC", "WenQuanYi Micro Hei"),
    },
}
GENERIC = frozenset(
    "serif sans-serif monospace cursive fantasy system-ui ui-serif ui-sans-serif ui-monospace emoji math fangsong inherit initial unset".split()
)
SIMPLIFIED_HINTS = (
    "宋体", "宋體", "simsun", "nsimsun", "新宋体", "新宋體", "仿宋", "fangsong", "楷体", "楷體", "kaiti", "黑体", "黑體", "simhei", "微软雅黑", "微軟雅黑",
    "microsoft yahei", "华文宋体", "華文宋體", "华文黑体", "華文黑體", "华文楷体", "華文楷體", "方正", "汉仪", "漢儀", "华康", "華康",
)
#: Words in a font's name that are wanted first, by the output's locale.
REGIONAL = {1: ("HK", "TC"), 2: ("TC", "HK")}

_BLANK = re.compile(r"\s+")
_RULE = re.compile(r"(?s)(?P<skip>/\*.*?\*/)|(?P<selector>[^{}@;/]+?)\s*\{(?P<body>[^{}]*)\}")
_FACE = re.compile(r"(?is)@font-face\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}\s*")
_FAMILY = re.compile(r"(?i)font-family\s*:\s*([^;}{]+)")
_LOCAL = re.compile(r"""(?i)src\s*:[^;]*url\s*\(\s*['"]?(?!https?:|data:)[^'")\s]""")


def _squeezed(text: str) -> str:
    return _BLANK.sub("", text)


def with_rule(css: str, selector: str, declarations: str, anywhere: bool = False) -> str:
    """A sheet whose first rule of a selector has just these declarations; one is added at the end if there is none.

    Spaces do not count; anywhere: the selector may be one of several of its rule.
    """
    wanted = _squeezed(selector)
    for found in _RULE.finditer(css):
        if found["skip"]:
            continue
        names = _squeezed(found["selector"])
        if names == wanted or anywhere and wanted in names.split(","):
            if _squeezed(found["body"]).rstrip(";") == _squeezed(declarations).rstrip(";"):
                return css
            return f"{css[: found.start('body')]}{declarations}{css[found.end('body') :]}"
    return f"{css.rstrip()}\n{selector}{{{declarations}}}\n".lstrip("\n")


def with_properties(css: str, selector: str, properties: Mapping[str, str]) -> tuple[str, bool]:
    """(sheet, found): properties set in every rule of a selector, their others kept."""
    wanted, out, at, any_rule = _squeezed(selector), [], 0, False
    for found in _RULE.finditer(css):
        if found["skip"] or wanted not in _squeezed(found["selector"]).split(","):
            continue
        any_rule = True
        own = dict((k.strip().lower(), v.strip()) for k, colon, v in (d.partition(":") for d in found["body"].split(";")) if colon)
        if all(own.get(k) == v for k, v in properties.items()):
            continue
        out += [css[at : found.start("body")], ";".join(f"{k}:{v}" for k, v in {**own, **properties}.items())]
        at = found.end("body")
    return "".join([*out, css[at:]]), any_rule


def with_annotation_rules(css: str) -> str:
    for selector, declarations in ANNOTATION_RULES.items():
        css = with_rule(css, selector, declarations, anywhere=True)
    return css


def direction_properties(orientation: int) -> dict[str, str]:
    """Properties of the body of a horizontal (1) or vertical (2) book."""
    mode, breaks = {1: ("horizontal-tb", "auto"), 2: ("vertical-rl", "normal")}[orientation]
    return {"writing-mode": mode, "-epub-writing-mode": mode, "-webkit-writing-mode": mode, "line-break": breaks, "-webkit-line-break": breaks}


def with_direction(css: str, orientation: int, add: bool = True) -> str:
    """A sheet whose rules of converted bodies have the direction; one is added if there is none and add says so."""
    selector, properties = f"body.{BODY_CLASS}", direction_properties(orientation)
    changed, found = with_properties(css, selector, properties)
    return changed if found or not add else f"{css.rstrip()}\n{selector}{{{';'.join(f'{k}:{v}' for k, v in properties.items())}}}\n".lstrip("\n")


def font_stack(policy: str, locale: int = 0, system: str = "linux") -> str:
    """A font-family value: the given system's fonts first, in each those for the locale first; empty for keep."""
    if policy not in FONTS:
        return ""
    wanted = REGIONAL.get(locale, ("SC",))
    names: dict[str, str] = {}
    for key in (system, *(k for k in ("win", "mac", "linux") if k != system)):
        for name in sorted(FONTS[policy][key], key=lambda n: not any(w in n.upper() for w in wanted)):
            names.setdefault(name.lower(), name)
    quoted = ['"' + n.replace('"', '\\"') + '"' if " " in n or not n.isascii() else n for n in names.values()]
    return ", ".join([*quoted, "serif" if policy == "serif" else "sans-serif"])


def font_declarations(policy: str, locale: int = 0, system: str = "linux") -> str:
    stack = font_stack(policy, locale, system)
    return f"font-family:{stack} !important" if stack else ""


def with_font_policy(css: str, policy: str, locale: int = 0, system: str = "linux") -> str:
    declarations = font_declarations(policy, locale, system)
    return with_rule(css, f"body.{BODY_CLASS}, body.{BODY_CLASS} *", declarations) if declarations else css


def without_font_faces(css: str) -> str:
    return _FACE.sub("", css)


def _families(css: str) -> Iterable[str]:
    for value in _FAMILY.findall(css):
        for name in value.split(","):
            bare = name.strip().strip("\"'").strip()
            if bare and bare.lower() not in GENERIC:
                yield bare


def font_uses(css: str) -> list[tuple[str, bool]]:
    """(family, embedded) of each family that a sheet names, once; embedded: a face of it has a local file."""
    found: dict[str, bool] = {}
    for face in _FACE.findall(css):
        local = bool(_LOCAL.search(face))
        for name in _families(face):
            found[name] = found.get(name, False) or local
    for name in _families(_FACE.sub("", css)):
        found.setdefault(name, False)
    return list(found.items())


def looks_simplified(family: str) -> bool:
    """Whether a family's name hints at a font made for simplified text."""
    return any(hint in family.lower() for hint in SIMPLIFIED_HINTS)

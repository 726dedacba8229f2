"""Small dictionaries and Han text for the queries; the tables hold Latin prose only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.plans.program import Dictionary, Program

LATIN = "abcdefghijklmnopqrstuvwxy"
SIMPLIFIED = "后发干里面云台只系谷松曲丑斗范丰几姜借卷困胡回汇获"
TRADITIONAL = "後發乾裡麵雲臺隻係穀鬆麯醜鬥範豐幾薑藉捲睏鬍迴匯獲"
PHRASES = {"卷系范斗": "狀態中", "卷只面": "這個", "系斗台": "進行著", "后斗里": "和", "面姜": "者們", "面斗": "面斗"}
REGIONAL = {"裡": "裏", "臺": "台", "這": "呢"}

CHARACTERS = Dictionary.of("characters", dict(zip(SIMPLIFIED, TRADITIONAL)))
CHARACTER_PROGRAM = Program("characters", ((CHARACTERS,),))
PHRASE_PROGRAM = Program("phrases", ((Dictionary.of("phrases", PHRASES), CHARACTERS), (Dictionary.of("regional", REGIONAL),)))


def han(text: Column) -> Column:
    """Latin letters as Han characters, so that conversion has work to do."""
    return F.translate(F.lower(text), LATIN, SIMPLIFIED)


HAN_SQL = f"translate(lower(text), '{LATIN}', '{SIMPLIFIED}')"


def phrase_sql(source: str) -> tuple[str, str, str]:
    """SQL of a text with its phrases masked, of the first stage's result, and of the whole program's."""
    masked, back = source, ""
    for i, (key, _) in enumerate(sorted(PHRASES.items(), key=lambda p: (-len(p[0]), p[0]))):
        masked = f"replace({masked}, '{key}', chr({57344 + i}))"
    back = f"translate({masked}, '{SIMPLIFIED}', '{TRADITIONAL}')"
    for i, (_, target) in enumerate(sorted(PHRASES.items(), key=lambda p: (-len(p[0]), p[0]))):
        back = f"replace({back}, chr({57344 + i}), '{target}')"
    return masked, back, f"translate({back}, '{''.join(REGIONAL)}', '{''.join(REGIONAL.values())}')"

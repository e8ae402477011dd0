"""Kana: script conversion, moras and romaji."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIRA = "".join(chr(c) for c in range(0x3041, 0x3097))
_KATA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))


def to_hiragana(text: Column) -> Column:
    return F.translate(text, _KATA, _HIRA)


def to_katakana(text: Column) -> Column:
    return F.translate(text, _HIRA, _KATA)


def _rows() -> dict[str, str]:
    """Mora spellings from the fifty-sound grid: a row of five kana for each consonant, then the exceptions."""
    out = {}
    for onset, row in (("", "アイウエオ"), ("k", "カキクケコ"), ("s", "サシスセソ"), ("t", "タチツテト"), ("n", "ナニヌネノ"), ("h", "ハヒフヘホ"), ("m", "マミムメモ"), ("r", "ラリルレロ"), ("g", "ガギグゲゴ"), ("z", "ザジズゼゾ"), ("d", "ダヂヅデド"), ("b", "バビブベボ"), ("p", "パピプペポ")):
        out |= {k: onset + v for k, v in zip(row, "aiueo", strict=True)}
    out |= {"ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ッ": "cl", "ヴ": "vu"}
    out |= {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu"}
    # a kana of the i column with a small y-kana: the consonant, palatal
    for kana, onset in (("キ", "ky"), ("シ", "sh"), ("チ", "ch"), ("ニ", "ny"), ("ヒ", "hy"), ("ミ", "my"), ("リ", "ry"), ("ギ", "gy"), ("ジ", "j"), ("ビ", "by"), ("ピ", "py")):
        out |= {kana + small: onset + v for small, v in (("ャ", "a"), ("ュ", "u"), ("ョ", "o"))}
    for kana, onset, small in (("フ", "f", "ァィェォ"), ("ヴ", "v", "ァィェォ"), ("ウ", "w", "ィェォ")):
        out |= {kana + s: onset + "aieo"["ァィェォ".index(s)] for s in small}
    return out | {"ティ": "ti", "ディ": "di", "トゥ": "tu", "ドゥ": "du", "チェ": "che", "ジェ": "je", "シェ": "she", "クァ": "kwa", "グァ": "gwa"}


MORAS = _rows()
#: The first kana of each spelling, in hiragana.
_TO_HIRA = str.maketrans(_KATA, _HIRA)
KANA_OF: dict[str, str] = {}
for _k, _v in MORAS.items():
    KANA_OF.setdefault(_v, _k.translate(_TO_HIRA))
VOWEL_KANA = dict(zip("aiueo", "アイウエオ", strict=True))
#: Two kana before one; a long mark; other letters.
MORA_PATTERN = "|".join(sorted(MORAS, key=len, reverse=True)) + "|ー|\\p{L}"


def mora_pairs(text: str | None) -> list[tuple[str, str]]:
    """(katakana, romaji) of each mora. A long mark repeats the vowel before it, but not behind cl and n; other letters stand for themselves."""
    out: list[tuple[str, str]] = []
    i, x = 0, (text or "").translate(str.maketrans(_HIRA, _KATA))
    while i < len(x):
        size = 2 if x[i : i + 2] in MORAS and len(x[i : i + 2]) == 2 else 1
        unit = x[i : i + size]
        i += size
        if unit in MORAS:
            out.append((unit, MORAS[unit]))
        elif unit == "ー":
            if out and out[-1][1] not in ("cl", "n"):
                v = out[-1][1][-1]
                out.append((VOWEL_KANA.get(v, unit), v))
        elif unit.isalpha():
            out.append((unit.lower(), unit.lower()))
    return out


def _mapped(f: Callable, col: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f(v))

    return run(col)


def romaji_moras(text: Column) -> Column:
    return _mapped(lambda x: [r for _, r in mora_pairs(x)], text)


def kana_moras(text: Column) -> Column:
    return _mapped(lambda x: [k.translate(_TO_HIRA) for k, _ in mora_pairs(x)], text)


#: Consonants that a vowel may follow, and spellings that differ from the plain join (fixed values).
CONSONANTS = "b by ch d dy f fy g gw gy h hy j k kw ky m my n ny p py r ry s sh t ts ty v w y z".split()
SPELLED = {"si": "shi", "zi": "ji", "kyi": "ki", "gyi": "gi", "nyi": "ni", "hyi": "hi", "myi": "mi", "ryi": "ri", "byi": "bi", "pyi": "pi", "tyi": "chi", "tyu": "chu", "tyo": "cho", "dyi": "ji", "dyu": "ju", "dyo": "jo"}


def join_phonemes(tokens: Column) -> Column:
    """Phonemes to romaji moras: a consonant takes the vowel behind it; SP goes, AP, EP and cl stay, N is n.

    Each token is looked at with the ones beside it, so this is a transform and no fold."""
    vowel = lambda t: t.isin("a", "i", "u", "e", "o", "I", "U")
    cons = lambda t: t.isin(*CONSONANTS)
    spelled = F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv])

    def one(t: Column, i: Column) -> Column:
        nxt = F.coalesce(F.get(tokens, i + 1), F.lit(""))
        prev = F.when(i > 0, F.get(tokens, i - 1)).otherwise("")
        pair = F.concat(t, F.lower(nxt))
        return (
            F.when(t == "SP", "")
            .when(t.isin("AP", "EP"), t)
            .when(t == "N", "n")
            .when(vowel(t), F.when(cons(prev), "").otherwise(F.lower(t)))
            .when(cons(t) & vowel(nxt), F.coalesce(F.try_element_at(spelled, pair), pair))
            .otherwise(F.lower(t))
        )

    return F.filter(F.transform(tokens, one), lambda t: t != "")


def display_moras(moras: Column, kana: Column) -> Column:
    """Moras without AP, EP and SP: as kana where ``kana`` holds, else in lower case."""
    low = F.transform(F.filter(moras, lambda t: ~t.isin("AP", "EP", "SP", "")), lambda t: F.lower(t))
    names = F.create_map(*[F.lit(x) for kv in KANA_OF.items() for x in kv])
    return F.when(kana, F.transform(low, lambda t: F.coalesce(F.try_element_at(names, t), t))).otherwise(low)

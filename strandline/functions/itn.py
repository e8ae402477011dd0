"""Chinese spoken numbers to digits.

A span of numeral characters is parsed by kind: fixed phrases and vague counts stay;
ranges, times, digit strings, runs of values, values, percentages, fractions, ratios
and dates are written in digits. What does not parse stays as it is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"幺": 1, "两": 2}
POWER = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
#: Units that may stand behind a number, with their short form (fixed values).
UNITS = {u: u for u in "个 只 分 万 亿 秒 年 月 日 天 时 钟 人 层 楼 倍 块 次 米 千米".split()} | {"克": "g", "千克": "kg", "千米每小时": "km/h"}
#: Phrases in which numerals count nothing (fixed values).
PHRASES = """正经八百 五零二落 五零四散 五十步笑百步 乌七八糟 污七八糟 四百四病 思绪万千 十有八九 十之八九 三十而立 三十六策 三十六计 三十六行
三五成群 三百六十行 三六九等 七老八十 七零八落 七零八碎 七七八八 乱七八遭 乱七八糟 略知一二 零零星星 零七八碎 九九归一 二三其德 二三其意 无银三百两 八九不离十
百分之百 年三十 烂七八糟 一点一滴 路易十六 九三学社 五四运动 入木三分 九九八十一 三七二十一 十二五 十三五 十四五 十五五 十六五 十七五 十八五""".split()

_N, _D = "零一二两三四五六七八九十百千万", "零幺一二两三四五六七八九"
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
SPAN = re.compile(f"(?:[几{_N}幺点比]|分之|(?<=[{_N}])[亿年月日号分秒])+(?:(?<=[{_N}])(?:{_UNIT}|[A-Za-z]))?")
_TIME = re.compile(f"([{_N}]+)点([{_N}]+)分(?:([{_N}]+)秒)?")
_DATE = re.compile(f"(?:([{_D}十]+)年)?(?:([{_D}十]+)月)?(?:([{_D}十]+)([日号]))?")
_VALUE = re.compile(f"十?(?:零?[一二两三四五六七八九十][十百千万]{{1,2}})*零?十?[一二两三四五六七八九]?(?:点[{_D}]+)?")


def _unit(text: str) -> tuple[str, str]:
    m = re.search(f"(?:{_UNIT}|[A-Za-z]+)$", text)
    if not m or not m.start():
        return text, ""
    return text[: m.start()], UNITS.get(m[0], m[0])


def value(text: str) -> str:
    """A positional number, with decimals behind 点. 二百五 is 250: a last digit without a power takes the next lower one."""
    whole, _, part = text.partition("点")
    total, section, digit, last = 0, 0, 0, 1
    for c in whole:
        if c in DIGIT:
            digit = DIGIT[c]
            last = 1 if c == "零" else last
        elif c == "万":
            total, section, digit, last = (total + section + digit) * POWER[c], 0, 0, POWER[c] // 10
        else:
            section += (digit or (c == "十")) * POWER[c]
            digit, last = 0, 1 if c == "十" else POWER[c] // 10
    return str(total + section + digit * last) + ("." + digits(part) if part else "")


def digits(text: str) -> str:
    return "".join("." if c == "点" else str(DIGIT[c]) for c in text)


def _range(core: str, unit: str) -> str | None:
    if m := re.fullmatch("([二三四五六七八九])([二三四五六七八九])([十百千万亿])([万千百亿]?)", core):
        a, b = DIGIT[m[1]], DIGIT[m[2]]
        if m[3] in "万亿" or m[3] == "千" and m[4]:
            return f"{a}~{b}{m[3]}{m[4]}{unit}"
        return f"{a * POWER[m[3]]}~{b * POWER[m[3]]}{m[4]}{unit}"
    if m := re.fullmatch("([一二三四五六七八九]?)([十百千万])([一二三四五六七八九])([一二三四五六七八九])([万千亿]?)", core):
        base, small = (DIGIT[m[1]] if m[1] else 1) * POWER[m[2]], POWER[m[2]] // 10
        return f"{base + DIGIT[m[3]] * small}~{base + DIGIT[m[4]] * small}{m[5]}{unit}"
    return None


def _number(text: str) -> str:
    core, _, fraction = text.partition("点")
    return value(text) if _VALUE.fullmatch(text) and core else text


def convert(span: str) -> str:
    if "几" in span:
        return span
    core, unit = _unit(span)
    raw_unit = span[len(core) :]
    if raw_unit in ("万", "亿"):
        core_range, unit_range = span, ""
    else:
        core_range, unit_range = core, unit
    if (r := _range(core_range, unit_range)) is not None:
        return r
    if m := _TIME.fullmatch(span):
        return ":".join(value(x).zfill(2) for x in m.groups() if x)
    if re.fullmatch(f"[{_D}]+(?:点[{_D}]+)*", core):
        return span if core == "一" else digits(core) + unit
    if re.fullmatch("(?:十[一二三四五六七八九]){2,}", core) or re.fullmatch("(?:[一二三四五六七八九]百零?[一二三四五六七八九]){2,}", core):
        return " ".join(value(x) for x in re.findall("十[一二三四五六七八九]|[一二三四五六七八九]百零?[一二三四五六七八九]", core)) + unit
    if _VALUE.fullmatch(core) and core[:1] != "点":
        return value(core) + unit
    if span.startswith("百分之"):
        rest = span[3:]
        return value(rest) + "%" if _VALUE.fullmatch(rest) else span
    if span.count("分之") == 1:
        low, high = span.split("分之")
        return f"{value(high)}/{value(low)}" if low and high and _VALUE.fullmatch(low) and _VALUE.fullmatch(high) else span
    if span.count("比") == 1:
        a, b = span.split("比")
        return f"{value(a)}:{value(b)}" if a and b and _VALUE.fullmatch(a) and _VALUE.fullmatch(b) else span
    if (m := _DATE.fullmatch(span)) and any(m.groups()):
        year = digits(m[1]) + "年" if m[1] and "十" not in m[1] else (m[1] + "年" if m[1] else "")
        return year + (value(m[2]) + "月" if m[2] else "") + (value(m[3]) + m[4] if m[3] else "")
    return span


def to_digits(text: str | None) -> str | None:
    """``text`` with its spoken numbers in digits."""
    if text is None:
        return None
    fixed = [m.span() for p in PHRASES for m in re.finditer(p, text)]

    def one(m: re.Match) -> str:
        if any(a < m.end() and m.start() - 2 <= a for a, _ in fixed):
            return m[0]
        try:
            return convert(m[0])
        except (KeyError, ValueError):
            return m[0]

    return SPAN.sub(one, text)


def digits_written(col: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(to_digits)

    return run(col)

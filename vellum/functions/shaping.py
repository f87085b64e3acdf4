"""Text functions that need a state machine, over Arrow batches: bidi order, Arabic forms, NFC, word wrap."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _strong(c: str) -> bool | None:
    """True for right-to-left letters (Hebrew and Arabic blocks), None for what follows its neighbours, else False."""
    k = ord(c)
    if 0x590 <= k <= 0x6FF or 0x750 <= k <= 0x77F or 0x8A0 <= k <= 0x8FF:
        return True
    return None if c in "0123456789.,-+$£¥€ \t()\"'" or 0x300 <= k <= 0x36F or 0x1AB0 <= k <= 0x1AFF or 0x1DC0 <= k <= 0x1DFF or 0x20D0 <= k <= 0x20FF else False


def reorder(s: str, rtl: bool = False) -> str:
    """Runs of one direction, right-to-left ones reversed; the order of runs stays. Neutrals and digits join the run before them."""
    at = next((d for d in map(_strong, s) if d is not None), rtl)
    runs: list[tuple[bool, list[str]]] = []
    for c in s:
        d = _strong(c)
        at = at if d is None else d
        if not runs or runs[-1][0] != at:
            runs.append((at, []))
        runs[-1][1].append(c)
    return "".join("".join(reversed(r) if d else r) for d, r in runs)


def _joins(c: str) -> bool:
    return "آ" <= c <= "غ" or "ف" <= c <= "ي"


def _presentation() -> dict[str, str]:
    """Presentation forms of single Arabic letters, by the decomposition that names form and letter."""
    return {unicodedata.decomposition(chr(k)): chr(k) for k in range(0xFE80, 0xFEFD)}


FORMS = _presentation()


def shape(s: str) -> str:
    """Presentation forms of joining letters by their neighbours, final before initial, as the Unicode decompositions of the presentation forms give them."""
    out = []
    for i, c in enumerate(s):
        if not _joins(c):
            out.append(c)
            continue
        before, after = i > 0 and _joins(s[i - 1]), i + 1 < len(s) and _joins(s[i + 1])
        tag = "<final>" if before else "<initial>" if after else "<isolated>"
        out.append(FORMS.get(f"{tag} {ord(c):04X}", c))
    return "".join(out)


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def wrap(s: str, width: float, measure=len) -> list[str]:
    """Greedy lines of at most width; blanks collapse; words that do not fit are cut between graphemes."""
    import re

    clusters = re.compile("(?s).[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]*")
    if not s:
        return [""]
    lines, line = [], ""
    for word in re.split("[ \t\n\r]+", s):
        if not word:
            continue
        joined = f"{line} {word}" if line else word
        if line and measure(joined) > width:
            lines.append(line)
            joined = word
        line = joined
        while measure(line) > width:
            cut = 0
            for m in clusters.finditer(line):
                if cut and measure(line[: m.end()]) > width:
                    break
                cut = m.end()
            lines.append(line[:cut])
            line = line[cut:]
    return [*lines, line] if line else lines


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def reorder_bidi(s: Column) -> Column:
    return _udf(reorder, "string")(s)


def shape_arabic(s: Column) -> Column:
    return _udf(shape, "string")(s)


def normalize_nfc(s: Column) -> Column:
    return _udf(nfc, "string")(s)


def word_wrap(s: Column, width: int) -> Column:
    return _udf(lambda x: wrap(x, width), "array<string>")(s)

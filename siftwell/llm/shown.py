"""The text as a reader sees it: one canonical spelling per appearance.

`canonical` works on one Python string. `shown` is the column: plain ASCII texts stay in the JVM; only the others cross
to Python, once, through Arrow. `folded` is a coarser fold for counting
(accents dropped as well), wholly in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like Latin ones, and hyphens that look alike.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝ"  # Cyrillic
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ"  # Greek
        "օսհո",  # Armenian
        "ABEKMHOPCTYXSIJaeopcyxsijhdqw" "ABEZHIKMNOPTYXoj" "ouhn",
        strict=True,
    )
)
HYPHENS = "‐‑‒⁃−˗﹣－"
#: Invisible, but not of the category for format characters.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"

_RANGES = ((0, 0x3400), (0xA640, 0xABC0), (0xF900, 0x10000), (0x1D100, 0x1D800), (0x1F100, 0x1F200), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def _ignorable(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or c in INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or (unicodedata.category(c) == "Cc" and not c.isspace())


@lru_cache(maxsize=1)
def replacements() -> dict[int, str]:
    """What each character is replaced by after canonical decomposition; characters that stand for themselves are absent.

    Width forms, ligatures and radicals are replaced by what they are compatible with; raised, lowered, circled and squared
    signs, fractions and font variants look different and stay.
    """
    table: dict[int, str] = {}
    for low, high in _RANGES:
        for o in range(low, high):
            c = chr(o)
            if _ignorable(c):
                table[o] = ""
            elif c.isspace():
                if c != " ":
                    table[o] = " "
            elif c in HYPHENS:
                table[o] = "-"
            else:
                kind, _, rest = unicodedata.decomposition(c).rpartition(">")
                if kind in ("<wide", "<narrow", "<compat", "<noBreak", "<initial", "<medial", "<final", "<isolated") and not rest.strip().startswith("0020"):
                    to = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
                    table[o] = "".join(LOOKALIKES.get(x, x) for x in to)
                elif c in LOOKALIKES:
                    table[o] = LOOKALIKES[c]
    return table


def canonical(text: str) -> str:
    """The one form of all texts that look like this one: NFC, single inner blanks, none at the ends."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(replacements())).split())


def _ranges(points: list[int]) -> str:
    """A Java character class body of the code points."""
    out, points = [], sorted(points)
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
BLANK_CLASS = f"[{_ranges([ord(c) for c in BLANKS])}]"


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def shown(text: Column) -> Column:
    """`canonical` as a column; null stays null."""
    easy = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(_canonical(F.when(text.rlike(r"[^\x09-\x0d\x20-\x7e]"), text)), easy)


@lru_cache(maxsize=1)
def _fold_pairs() -> tuple[str, str]:
    pairs = {}
    for low, high in ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2200), (0x2E80, 0x2FE0), (0xFF01, 0xFF5F)):
        for o in range(low, high):
            c = chr(o)
            to = unicodedata.normalize("NFD", c).translate(replacements())
            to = "".join(x for x in to if not unicodedata.combining(x))
            if len(to) == 1 and to != c:
                pairs[c] = to
    pairs |= dict.fromkeys(HYPHENS, "-")
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """A coarser form for counting: as `shown`, without accents, and a mark of elision as three dots. Null stays null."""
    invisible = "[\\p{Cf}\\p{Mn}" + _ranges([ord(c) for c in INVISIBLE]) + "]+"
    easy = F.translate(F.regexp_replace(text, invisible, ""), *_fold_pairs())
    for lig, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        easy = F.replace(easy, F.lit(lig), F.lit(letters))
    return F.trim(F.regexp_replace(easy, BLANK_CLASS + "+", " "))


#: A word of shown text: a Han character, or a run of other letters and digits.
WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]|[^\W_㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]+")

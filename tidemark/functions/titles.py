"""Titles from first prompts, and semantic units of a text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, ENOUGH = 72, 20
_NOISE = re.compile(r"^\s*(?:```|~~~|[-=*_#|]{3,}|\d{4}-\d\d-\d\dT|at \S+ \(|[\w./-]+:\d+|[{}\[\]();]+|https?://\S+|<[^>]+>|\$ |> ?$)")
_MARKDOWN = re.compile(r"^\s*(?:#{1,6}\s+|>\s*|[-*+•]\s+|\d+[.)]\s+)|[*_`]{1,3}|\[([^\]]*)\]\([^)]*\)")
#: Where units of a text end, and how the items of a list begin.
_UNITS = re.compile(r"\n\s*\n|(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])")
_ITEM = re.compile(r"\s*(?:[-*]|\d+[.)])\s")
#: What stands for text left out before and after.
OMITTED_BEFORE, OMITTED_AFTER = "[Earlier text omitted from this turn.]", "[Later text omitted from this turn.]"


def title(prompt: str | None) -> str | None:
    """A title: the first line of some length that is no noise, without markup, cut at a word; null if nothing is left."""
    best = None
    for line in (prompt or "").splitlines():
        if _NOISE.match(line):
            continue
        text = " ".join(_MARKDOWN.sub(lambda m: m[1] or "", line).split())
        if not any(map(str.isalnum, text)):
            continue
        if len(text) >= ENOUGH:
            best = text
            break
        best = best or text
    if best is None or len(best) <= LIMIT:
        return best
    cut = best[:LIMIT - 1]
    return (cut[:cut.rfind(" ")] if " " in cut[LIMIT // 2:] else cut).rstrip(" ,;:-") + "…"


def units(text: str | None) -> list[str]:
    """Sentences and paragraphs of a text; a list stays with what leads it in, and so does whatever follows a colon."""
    out: list[str] = []
    for part in _UNITS.split((text or "").strip()):
        if not part.strip():
            continue
        if out and (_ITEM.match(part) or out[-1].rstrip().endswith(":")):
            out[-1] += "\n\n" + part
        else:
            out.append(part)
    return out


def pack_evidence(parts: list[str], limit: int, omitted_before: bool = False, extra: int = 0) -> tuple[str, int] | None:
    """The first units, in order, as far as they fit with the marks for what is left out and ``extra`` characters; and how many are left out. None if the first does not fit."""
    best = None
    for n in range(1, len(parts) + 1):
        text = "\n\n".join([*([OMITTED_BEFORE] if omitted_before else []), *parts[:n], *([OMITTED_AFTER] if n < len(parts) else [])])
        if len(text) + extra > limit:
            break
        best = text, len(parts) - n
    return best


def derived_title(x: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(title)

    return run(x)


def text_units(x: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(units)

    return run(x)


def nfkc(x: Column) -> Column:
    """Unicode compatibility form; ASCII texts stay in the JVM."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    # letters of Latin-1 and typographic quotes and dashes are their own compatibility form; what needs none goes to Python as null
    odd = (F.octet_length(x) != F.length(x)) & x.rlike(r"[^\x00-\x7f\u00c0-\u00ff\u2010\u2012-\u2016\u2018-\u2023\u20ac]")
    return F.coalesce(run(F.when(odd, x)), x)

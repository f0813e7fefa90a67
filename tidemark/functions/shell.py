"""Shell syntax in texts: detect it, strip it, escape it.

These are fix-point and parity rules that column expressions cannot state, so
they run as Arrow-batched Pandas functions; texts without any of the marks are
told apart in the JVM first and reach Python as nulls.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import ANSI, CONTROL

#: What a shell would act on, anywhere or at the start of a line, and what is taken out of texts in any case.
MARKS = rf"`|[$<>]\(|\$\{{|<<|(?m)^[ \t]*\\*[|;&]|{ANSI}|{CONTROL}"
_UNSEEN = re.compile(f"{ANSI}|{CONTROL}")
#: Openers, here-documents, operators at the start of a line with the backslashes before them, backticks.
_PAIRED = re.compile(r"[$<>]\(|\$\{")
_HERE = re.compile(r"(\\*)<<")
_LEADING = re.compile(r"^([ \t]*)((?:\\*[|;&])+)", re.M)
_RUN = re.compile(r"(\\*)([|;&])")
_TICK = re.compile(r"(\\*)`")
_BRACKET = re.compile(r"([$<>]?)([(){}])")
PASSES = 8


def _active(m: re.Match) -> bool:
    """Whether an even number of backslashes stands before a character, so that none escapes it."""
    return len(m[1]) % 2 == 0


def _chains(text: str, change) -> str:
    """Rewrite the operators at the start of lines, where any of them is active."""
    return _LEADING.sub(lambda m: m[1] + change(m[2]) if any(map(_active, _RUN.finditer(m[2]))) else m[0], text)


def _without_pairs(text: str) -> str:
    """Openers taken out with the brackets that close them, or alone where nothing does."""
    out: set[int] = set()
    open_: dict[str, list[int]] = {")": [], "}": []}  # where the opener of each bracket begins, -1 for a plain bracket
    for m in _BRACKET.finditer(text):
        if m[2] in open_:
            stack = open_[m[2]]
            if stack and (at := stack.pop()) >= 0:
                out |= {at, at + 1, m.end() - 1}
        else:
            special = m[1] and (m[2] == "(" or m[1] == "$")
            open_[")" if m[2] == "(" else "}"].append(m.start() if special else -1)
    out |= {i for stack in open_.values() for at in stack if at >= 0 for i in (at, at + 1)}
    return "".join(c for i, c in enumerate(text) if i not in out) if out else text


def stripped(text: str) -> str:
    """The text with its words but without marks: openers and what closes them, backticks, here-documents and operators at the start of a line, again until nothing changes, at most ``PASSES`` times."""
    text = _UNSEEN.sub("", text)
    for _ in range(PASSES):
        new = _chains(_without_pairs(text).replace("`", "").replace("<<", ""), lambda chain: "")
        if new == text:
            break
        text = new
    return text


def escaped(text: str) -> str:
    """A backslash that breaks each mark: within openers and here-documents, before active backticks and operators at the start of a line."""
    text = _PAIRED.sub(lambda m: f"{m[0][0]}\\{m[0][1]}", _UNSEEN.sub("", text))
    text = _HERE.sub(lambda m: m[1] + ("<\\<" if _active(m) else "<<"), text)
    text = _TICK.sub(lambda m: m[1] + ("\\`" if _active(m) else "`"), text)
    return _chains(text, lambda chain: _RUN.sub(lambda m: m[1] + ("\\" if _active(m) else "") + m[2], chain))


def detected(text: str) -> bool:
    """Whether anything stands in the text that either of the above would change."""
    return bool(_UNSEEN.search(text) or _PAIRED.search(text)) or any(_active(m) for rx in (_HERE, _TICK) for m in rx.finditer(text)) or any(_active(r) for m in _LEADING.finditer(text) for r in _RUN.finditer(m[2]))


def _apply(f, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def strip_shell(x: Column) -> Column:
    return F.coalesce(_apply(stripped, T.StringType())(F.when(x.rlike(MARKS), x)), x)


def escape_shell(x: Column) -> Column:
    return F.coalesce(_apply(escaped, T.StringType())(F.when(x.rlike(MARKS), x)), x)


def has_shell(x: Column) -> Column:
    return F.coalesce(_apply(detected, T.BooleanType())(F.when(x.rlike(MARKS), x)), F.lit(False))

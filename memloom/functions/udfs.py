"""The few functions that no expression can state: sequence similarity and repairs of broken JSON."""

from __future__ import annotations

import ast
import json
import math
import re
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD_TOKEN

_TOKEN = re.compile(r"[a-zA-Z0-9']+")


@lru_cache(1024)
def _clean(text: str) -> str:
    return " ".join(re.sub(r"[^a-zA-Z0-9\\s']+", " ", (text or "").strip().lower()).split())


def token_set(text: str | None) -> set[str]:
    """As ``text.token_set``."""
    return {t.lower() for t in re.findall(WORD_TOKEN, text or "")}


def similarity(a: str | None, b: str | None) -> float:
    """Larger of the sequence ratio (of a against b, not symmetric) and the token Jaccard of the cleaned texts."""
    a, b = _clean(a), _clean(b)
    if not a or not b:
        return 0.0
    x, y = set(_TOKEN.findall(a)), set(_TOKEN.findall(b))
    share = len(x & y) / len(x | y) if x and y else 0.0
    return max(SequenceMatcher(None, a, b).ratio(), share)


@lru_cache(64)
def _places(text: str) -> dict[str, int]:
    """For every letter of an ASCII text its places, as the bits of a number."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}


def common_letters(a: str, b: str, need: int) -> int:
    """Length of the longest common subsequence of two ASCII texts, or some number below ``need`` once it can't be reached."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    places, full, n = _places(a), (1 << len(a)) - 1, len(a)
    v = full  # a bit is off where the common subsequence grows by one
    for at in range(0, len(b), 256):
        if n - v.bit_count() + len(b) - at < need:
            return n - v.bit_count()
        for c in b[at : at + 256]:
            u = v & places.get(c, 0)
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _ratio_from(least: float, x: str, y: str) -> float:
    """Sequence ratio of cleaned texts where their longest common subsequence lets it reach ``least``, else 0."""
    need = math.ceil(least * (len(x) + len(y)) / 2 - 1e-9)
    if min(len(x), len(y)) < need or common_letters(x, y, need) < need:
        return 0.0
    return SequenceMatcher(None, x, y).ratio()


def similarity_from(least: float, a: str | None, b: str | None) -> float:
    """``similarity`` where it reaches ``least``, else that or something lower."""
    a, b = _clean(a), _clean(b)
    if not a or not b:
        return 0.0
    x, y = set(_TOKEN.findall(a)), set(_TOKEN.findall(b))
    share = len(x & y) / len(x | y) if x and y else 0.0
    return max(_ratio_from(least, a, b), share)


def sequence_ratio_from(least: float, a: Column, b: Column) -> Column:
    """Sequence ratio of cleaned texts a against b where it reaches ``least``, else 0.

    What the ratio counts is a common subsequence, so it isn't computed where the longest one is too short; that one is found
    with a word of bits for 64 letters at a time.
    """

    def one(x: str, y: str) -> float:
        ratio = _ratio_from(least, x, y)
        return ratio if ratio >= least else 0.0

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def cleaned_udf(c: Column) -> Column:
    """Text as ``similarity`` compares it: ASCII letters in lower case, digits, apostrophes, backslashes and single spaces."""
    return _mapped(_clean, c)


def similarity_udf(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def balanced_object(text: str | None) -> str:
    """First complete JSON object, minding strings and escapes; empty if there is none."""
    text = text or ""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return ""


def _open_brackets(text: str) -> str:
    """Closers of the brackets and the string that are open at the end."""
    stack, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return '"' * quoted + "".join(reversed(stack))


def repaired_json(text: str | None) -> str:
    """Canonical JSON of the first reading that parses: as it is, without trailing commas, with brackets closed,
    or with its item list cut after the last complete item. Empty if none does."""
    text = (text or "").strip()
    bare = re.sub(r",(\s*[}\]])", r"\1", text)
    tries = [text, bare, bare + _open_brackets(bare)]
    at = bare.rfind("}")
    while at > 0 and len(tries) < 12:
        head = bare[: at + 1]
        tries.append(head + _open_brackets(head))
        at = bare.rfind("}", 0, at)
    for t in tries:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return ""


def normalized_prediction(text: str | None) -> str:
    """A Python list literal as its items joined by commas; other texts unchanged."""
    raw = (text or "").strip()
    if raw.startswith("[") and raw.endswith("]"):
        try:
            value = ast.literal_eval(raw)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return raw
        if isinstance(value, list):
            return ", ".join(s for s in (str(v).strip() for v in value) if s)
    return raw


def _mapped(f, c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(run, "string")(c)


def balanced_object_udf(c: Column) -> Column:
    return _mapped(balanced_object, c)


def repaired_json_udf(c: Column) -> Column:
    return _mapped(repaired_json, c)


def normalized_prediction_udf(c: Column) -> Column:
    return _mapped(normalized_prediction, c)

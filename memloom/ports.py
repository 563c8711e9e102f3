"""Model calls behind ports: batched, retried, rate-limited, with deterministic offline stand-ins.

A port is a picklable object that answers a list of prompts. Results should be written before they are read twice,
so that a recomputed partition never repeats a call.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextPort:
    """Answers prompts with texts."""

    def complete(self, prompts: list[str]) -> list[str]:
        raise NotImplementedError


class EmbeddingPort:
    """Answers texts with vectors of ``size`` numbers."""

    size = 1024

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


@dataclass
class FunctionPort(TextPort):
    """A stand-in that computes its answer."""

    answer: Callable[[str], str]

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


@dataclass
class HashEmbedding(EmbeddingPort):
    """A stand-in: signed counts of hashed words, of unit length. Texts that share words are near; nothing else is claimed."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


@dataclass
class Limits:
    """What a port may ask of its service from one partition."""

    batch: int = 16
    attempts: int = 3
    backoff_s: float = 0.5
    tokens_per_minute: int | None = None
    failures: int = 10
    clock: Callable[[], float] = field(default=time.monotonic)
    sleep: Callable[[float], None] = field(default=time.sleep)


class BudgetExceeded(RuntimeError):
    """Too many calls in a row have failed."""


class Caller:
    """Calls a port in batches, waits for the token window, retries with growing pauses, and gives up after a run of failures."""

    def __init__(self, limits: Limits):
        self.limits, self.window, self.failed = limits, [], 0

    def _wait(self, tokens: int) -> None:
        most = self.limits.tokens_per_minute
        if not most:
            return
        while True:
            now = self.limits.clock()
            self.window = [(t, n) for t, n in self.window if now - t < 60]
            if not self.window or sum(n for _, n in self.window) + tokens <= most:
                self.window.append((now, tokens))
                return
            self.limits.sleep(max(0.01, 60 - (now - self.window[0][0])))

    def call(self, f: Callable[[list[str]], list], texts: list[str]) -> list:
        self._wait(sum(max(1, int(len(t) / 3.2)) for t in texts if t))
        for attempt in range(self.limits.attempts):
            try:
                out = f(texts)
                self.failed = 0
                return out
            except Exception:
                self.failed += 1
                if self.failed >= self.limits.failures:
                    raise BudgetExceeded(f"{self.failed} calls in a row failed") from None
                if attempt + 1 == self.limits.attempts:
                    raise
                self.limits.sleep(self.limits.backoff_s * 2**attempt)
        return []


def complete(rows: DataFrame, prompt: str, port: TextPort, out: str = "reply", limits: Limits | None = None, keep_errors: bool = False) -> DataFrame:
    """``rows`` with the port's reply to each prompt; with ``keep_errors`` a prompt that fails, in its batch and alone, gives a null reply and its error."""
    limits, position = limits or Limits(), rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(limits)
        for frame in frames:
            replies, errors = [], []
            for lo in range(0, len(frame), limits.batch):
                asked = ["" if p is None else str(p) for p in frame[prompt].iloc[lo : lo + limits.batch]]
                try:
                    replies += caller.call(port.complete, asked)
                    errors += [None] * len(asked)
                except Exception as e:
                    if not keep_errors or isinstance(e, BudgetExceeded):
                        raise
                    # one by one, so that a prompt that can't be answered fails alone
                    for prompt_ in asked:
                        try:
                            if len(asked) == 1:
                                raise e
                            replies += caller.call(port.complete, [prompt_])
                            errors.append(None)
                        except Exception as one:
                            if isinstance(one, BudgetExceeded):
                                raise
                            replies.append(None)
                            errors.append(str(one))
            yield frame[position].assign(**{out: replies, "error": errors})

    return rows.mapInPandas(run, schema)


def embedder(port: EmbeddingPort, limits: Limits | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its vectors."""
    limits = limits or Limits()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        caller = Caller(limits)
        for texts in batches:
            out: list[list[float]] = []
            for lo in range(0, len(texts), limits.batch):
                out += caller.call(port.embed, ["" if t is None else t for t in texts.iloc[lo : lo + limits.batch]])
            yield pd.Series(out)

    udf = F.pandas_udf(run, "array<float>")
    return lambda c: udf(c)

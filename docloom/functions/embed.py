"""Embedders, and the policy for those that call a remote service."""

from __future__ import annotations

import contextlib
import queue
import random
import threading
import time
from collections import Counter, deque
from collections.abc import Callable, Sequence
from datetime import timezone
from email.utils import parsedate_to_datetime
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors of one length; may be pickled to executors."""

    dims: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


#: Distinct words of texts that are summed at a time: so many directions are in memory.
WORDS = 1 << 14


def _directions(words: list[str], dims: int) -> np.ndarray:
    """For each word, numbers in [-1, 1) that depend on it alone."""
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    x = h[:, None] + (np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    return x.astype(np.float64) / (1 << 52) - 1


class HashEmbedder:
    """Unit vectors from hashed words, the same in every process; blank texts give zeros."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), np.float64)
        held: list[tuple[int, Counter]] = []
        n = 0
        for i, t in enumerate(texts):
            held.append((i, Counter((t or "").lower().split())))
            n += len(held[-1][1])
            if n >= WORDS:
                self._add(out, held)
                held, n = [], 0
        self._add(out, held)
        return out.astype(np.float32).tolist()

    def _add(self, out: np.ndarray, held: list[tuple[int, Counter]]) -> None:
        """The sums of some texts' words, whose directions are made at once."""
        at: dict[str, int] = {}
        for _, words in held:
            for w in words:
                at.setdefault(w, len(at))
        directions = _directions(list(at), self.dims)
        for i, words in held:
            if words:
                times = np.fromiter(words.values(), np.float64, len(words))
                out[i] = (times[:, None] * directions[[at[w] for w in words]]).sum(axis=0)
            if size := float(np.linalg.norm(out[i])):
                out[i] /= size


def seconds_until(value: float | str | None) -> float | None:
    """Seconds that a Retry-After header asks for; None if it can't be read."""
    try:
        return None if value is None else max(0.0, float(value))
    except ValueError:
        with contextlib.suppress(ValueError, TypeError):
            at = parsedate_to_datetime(str(value))
            return max(0.0, (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() - time.time())
        return None


class RemoteError(RuntimeError):
    """A failed call; retry_after is the header's value: seconds, or an HTTP date."""

    def __init__(self, status: int, retry_after: float | str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, seconds_until(retry_after)


def retryable(status: int) -> bool:
    return status in (408, 429, 503) or status >= 500


class Policy:
    """Retries with exponential back-off and jitter, a circuit breaker, a limit on time and on
    calls at once. One per executor process."""

    def __init__(self, retries: int = 5, base: float = 2.0, total: float = 120.0, window: float = 30.0, share: float = 0.5, least: int = 10, rest: float = 30.0, at_once: int = 1, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.retries, self.base, self.total = retries, base, total
        self.window, self.share, self.least, self.rest = window, share, least, rest
        self.gate, self.sleep, self.clock = threading.Semaphore(at_once), sleep, clock
        self.seen: deque[tuple[float, bool]] = deque()
        self.open_until = 0.0

    def _note(self, ok: bool) -> None:
        now = self.clock()
        self.seen.append((now, ok))
        while self.seen and self.seen[0][0] < now - self.window:
            self.seen.popleft()
        bad = sum(not x for _, x in self.seen)
        if len(self.seen) >= self.least and bad >= self.share * len(self.seen):
            self.open_until = now + self.rest

    def _within(self, f: Callable[[], list[list[float]]], left: float) -> list[list[float]]:
        """f(), given up when the time that is left has passed; what hangs ends with its process."""
        got: queue.Queue = queue.Queue(1)

        def run() -> None:
            try:
                got.put((f(), None))
            except BaseException as e:  # noqa: BLE001 - raised again below
                got.put((None, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            out, error = got.get(timeout=max(0.001, left))
        except queue.Empty:
            self._note(False)
            raise TimeoutError(f"no answer within {self.total} s") from None
        if error is not None:
            raise error
        return out

    def call(self, f: Callable[[], list[list[float]]]) -> list[list[float]]:
        began = self.clock()
        with self.gate:
            for n in range(self.retries + 1):
                if self.clock() < self.open_until:
                    raise RuntimeError("the service is failing; its circuit is open")
                try:
                    out = self._within(f, self.total - (self.clock() - began))
                    self._note(True)
                    return out
                except RemoteError as e:
                    self._note(False)
                    wait = e.retry_after if e.retry_after is not None else self.base * 2**n * (1 + random.random() / 4)
                    if not retryable(e.status) or n == self.retries or self.clock() + wait - began > self.total:
                        raise
                    self.sleep(wait)
        raise AssertionError


class RemoteEmbedder:
    """Wraps a function that calls a service; raise RemoteError from it."""

    def __init__(self, call: Callable[[Sequence[str]], list[list[float]]], dims: int, **policy):
        self.request, self.dims, self.options, self.policy = call, dims, policy, None

    def __getstate__(self):
        return self.__dict__ | {"policy": None}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not len(texts):
            return []
        self.policy = self.policy or Policy(**self.options)
        return self.policy.call(lambda: self.request(texts))


def embedded(text: Column, embedder: Embedder) -> Column:
    """array<float> for each text, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(s.fillna("").tolist()))

    return run(text)

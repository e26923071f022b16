"""What a model answers, behind plain functions; deterministic stand-ins work offline.

A generator takes a prompt and returns an answer or raises. The chain tries generators in order
and, like all of this, never fails a task: failures become part of the result.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Generator = Callable[[str], str]
RESULT = "backend string, answer string, tokens_used int, retry_count int, failures array<string>"


class RateLimited(Exception):
    """Not worth a retry now."""


class QuotaExhausted(RateLimited):
    """Not worth any further call."""


@dataclass(frozen=True)
class Backend:
    name: str
    generate: Generator


def echo(prompt: str) -> str:
    """The offline stand-in: the prompt's last line."""
    lines = [x for x in prompt.splitlines() if x.strip()]
    return lines[-1].strip() if lines else ""


def chain_of(order: Sequence[str], known: dict[str, Generator]) -> list[Backend]:
    """The backends named by ``order``: it alone says which and in what order; repeats and unknown names are skipped, none is an error."""
    out = [Backend(n, known[n]) for n in dict.fromkeys(order) if n in known]
    if not out:
        raise ValueError("no backend is configured")
    return out


def with_retries(generate: Generator, prompt: str, attempts: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """The answer and the number of retries: waits double, there is none after the last try, and rate limits end it."""
    for k in range(attempts):
        try:
            return generate(prompt), k
        except RateLimited:
            raise
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(first_wait * 2**k)
    raise AssertionError


def run_chain(backends: Sequence[Backend], prompt: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    failures: list[str] = []
    for b in backends:
        try:
            answer, retries = with_retries(b.generate, prompt, sleep=sleep)
            return {"backend": b.name, "answer": answer, "tokens_used": len(answer.split()), "retry_count": retries, "failures": failures}
        except QuotaExhausted:
            raise
        except Exception as e:  # any other failure leads to the next backend
            failures.append(f"{b.name}: {type(e).__name__}: {e}")
    return {"backend": None, "answer": None, "tokens_used": 0, "retry_count": 0, "failures": failures}


def with_timeout(generate: Generator, seconds: float) -> Generator:
    """``generate`` that raises TimeoutError after ``seconds``, as a local model may take too long; the late call is left to end by itself."""

    def run(prompt: str) -> str:
        out: list = []

        def call() -> None:
            try:
                out.append((True, generate(prompt)))
            except Exception as e:  # handed to the caller below
                out.append((False, e))

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(seconds)
        if not out:
            raise TimeoutError(f"no answer in {seconds} s")
        ok, value = out[0]
        if not ok:
            raise value
        return value

    return run


def array_in(answer: str | None) -> list | None:
    """The JSON array in a model's answer, from the first bracket to the last; None if there is none to read."""
    found = re.search(r"\[.*\]", answer or "", re.S)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, list) else None


def until_readable(backends: Sequence[Backend], prompt: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The first result whose answer holds a JSON array, an empty one too; tokens of all attempts are counted. None readable: a null answer."""
    tokens = 0
    for _ in range(attempts):
        got = run_chain(backends, prompt, sleep)
        tokens += got["tokens_used"]
        if got["answer"] is None or array_in(got["answer"]) is not None:
            return got | {"tokens_used": tokens}
    return got | {"tokens_used": tokens, "answer": None, "failures": [*got["failures"], "unreadable"]}


class SlidingLimit:
    """At most ``calls`` in any ``seconds``; for one partition's loop."""

    def __init__(self, calls: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep, self.log = calls, seconds, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.log and now - self.log[0] >= self.seconds:
            self.log.popleft()
        if len(self.log) >= self.calls:
            self.sleep(self.seconds - (now - self.log[0]))
            self.log.popleft()
            now = self.clock()
        self.log.append(now)


def share_of(calls_a_minute: int, tasks: int) -> SlidingLimit:
    """The limit of one of ``tasks`` tasks, which together make at most ``calls_a_minute``: whole calls a minute, or one in several minutes."""
    each = calls_a_minute // tasks
    return SlidingLimit(each) if each else SlidingLimit(1, 60.0 * tasks / calls_a_minute)


def limited(backends: Sequence[Backend], limit: SlidingLimit) -> list[Backend]:
    """The backends, each call of which waits for its turn; retries and further backends count as calls."""

    def after(call: Generator) -> Generator:
        def run(prompt: str) -> str:
            limit.wait()
            return call(prompt)

        return run

    return [replace(b, generate=after(b.generate)) for b in backends]


def generate(prompt: Column, backends: Sequence[Backend], calls_a_minute: int | None = None, readable: bool = False, tasks: int | None = None) -> Column:
    """A struct RESULT for each prompt, by batches; not deterministic, so no filter moves below it and it isn't run twice.

    ``calls_a_minute`` is the whole job's, over every call of every backend: each of the ``tasks`` that run at once has its share, be it less than one call a minute.
    Without ``tasks`` they are as many as the session has cores. ``readable``: answers must hold a JSON array,
    or the backend is asked again. When a quota is exhausted, a task asks nothing more: the rest has the failure "quota" and stays to be done.
    """

    if calls_a_minute and tasks is None:
        tasks = SparkSession.active().sparkContext.defaultParallelism

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        asked = limited(backends, share_of(calls_a_minute, tasks)) if calls_a_minute else backends
        spent = {"backend": None, "answer": None, "tokens_used": 0, "retry_count": 0, "failures": ["quota"]}
        over = False
        for prompts in batches:
            rows = []
            for p in prompts:
                try:
                    rows.append(spent if over else (until_readable if readable else run_chain)(asked, p or ""))
                except QuotaExhausted:
                    over = True
                    rows.append(spent)
            yield pd.DataFrame(rows, columns=["backend", "answer", "tokens_used", "retry_count", "failures"])

    return run.asNondeterministic()(prompt)


def encoder(encode: Callable[[list[str]], Sequence[Sequence[float]]], prefix: str = "") -> Callable[[Column], Column]:
    """A column of vectors from a model that takes texts in batches; queries of some models need a prefix."""

    def apply(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, v)) for v in encode([prefix + (t or "") for t in texts])], dtype=object)

        return run(text)

    return apply


def pair_scorer(score: Callable[[list[str], list[str]], Sequence[float]]) -> Callable[[Column, Column], Column]:
    """A column of scores from a model that takes pairs of query and passage in batches, for reranking."""

    def apply(query: Column, passage: Column) -> Column:
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(score([x or "" for x in a], [x or "" for x in b]), dtype=float)

        return run(query, passage)

    return apply

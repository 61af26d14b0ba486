"""Outside services behind small interfaces: language models, OCR, translation."""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ChatClient(Protocol):
    def complete(self, messages: list[dict[str, str]], **options) -> str: ...


class Translator(Protocol):
    def translate(self, text: str) -> str: ...


class OcrProvider(Protocol):
    def read(self, image: bytes | None) -> str: ...


class Identity:
    """A translator that leaves texts as they are."""

    def translate(self, text: str) -> str:
        return text


@dataclass
class Scripted:
    """Answers by a function of the last message; for tests and local runs."""

    answer: Callable[[str], str]

    def complete(self, messages, **options) -> str:
        return self.answer(messages[-1]["content"])


@dataclass
class Retrying:
    """A client with bounded retries on errors and empty replies, and a pace.  Waits are
    random and grow from ``least`` to ``most`` seconds."""

    client: ChatClient
    attempts: int = 5
    least: float = 4.0
    most: float = 20.0
    pace: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def complete(self, messages, **options) -> str:
        error: Exception | None = None
        for k in range(self.attempts):
            if self.pace:
                self.sleep(self.pace)
            try:
                if reply := self.client.complete(messages, **options):
                    return reply
                error = ValueError("empty reply")
            except Exception as e:  # noqa: BLE001  any failure of a service is retried
                error = e
            if k + 1 < self.attempts:
                self.sleep(random.uniform(self.least, min(self.most, self.least * 2**k)))
        raise RuntimeError(f"no reply in {self.attempts} attempts") from error


def asking(make: Callable[[], object], one: Callable[[object, object], str | None], parallel: int = 1):
    """A column function that applies ``one(service, value)`` to every value, with one
    service made per task and ``parallel`` calls at a time; it is never asked twice for a row."""

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        service = make()
        with ThreadPoolExecutor(parallel) as pool:
            for values in batches:
                yield pd.Series(list(pool.map(lambda x: one(service, x), values)), dtype=object)

    return ask.asNondeterministic()


def credential(variable: str) -> str:
    """A key from the environment; it is never logged or put in a label."""
    if not (value := os.environ.get(variable)):
        raise ValueError(f"{variable} is not set")
    return value

"""Models behind one interface, and turns of a frame sent through them.

A chat model is any object with ``complete(messages, system=None)`` -> answer,
where a message is (role, parts) and a part a dict, and an answer a list of
parts. ``send`` is (method, path, body) -> response body; without a network a
function that returns written answers does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from threading import Lock
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.functions.parsing import decode_facts
from mnemograph.functions.prompt import EXTRACTION_INSTRUCTION
from mnemograph.functions.text import episode_text
from mnemograph.schema import EXTRACTED_FACT
from mnemograph.settings import MemorySettings

Send = Callable[[str, str, str], str]
Message = tuple[str, list[dict]]


class ChatModel(Protocol):
    def complete(self, messages: list[Message], system: str | None = None) -> list[dict]: ...


def first_text(parts: list[dict]) -> str | None:
    """The text of the first part; None if it is of another kind, or there is none."""
    text = parts[0].get("text") if parts else None
    return text if isinstance(text, str) else None


def _decoded(body: str) -> object:
    try:
        return json.loads(body)
    except ValueError:
        return None


def answer_text(body: str) -> str:
    """The first text of a chat response; empty if it has none."""
    found = _decoded(body)
    for step in ("candidates", 0, "content", "parts", 0, "text"):
        if isinstance(step, int):
            found = found[step] if isinstance(found, list) and len(found) > step else None
        else:
            found = found.get(step) if isinstance(found, dict) else None
    return found if isinstance(found, str) else ""


def cache_name(body: str) -> str | None:
    """The name in the answer to a cache request."""
    found = _decoded(body)
    name = found.get("name") if isinstance(found, dict) else None
    return name if isinstance(name, str) else None


@dataclass
class RemoteChat:
    """A remote chat service. The model is that of the object; a cached name stands in for the system instruction."""

    send: Send = field(repr=False)
    model: str

    def body(self, messages: list[Message], system: str | None = None, cached: str | None = None) -> str:
        """Messages whose first part is not text are left out."""
        texts = [(role, first_text(parts)) for role, parts in messages]
        contents = [{"role": "model" if role == "assistant" else "user", "parts": [{"text": t}]} for role, t in texts if t is not None]
        out: dict = {"contents": contents}
        if cached is not None:
            out["cachedContent"] = cached
        elif system is not None:
            out["systemInstruction"] = {"parts": [{"text": system}]}
        return json.dumps(out)

    def complete(self, messages: list[Message], system: str | None = None, cached: str | None = None) -> list[dict]:
        answer = self.send("POST", f"/models/{self.model}:generateContent", self.body(messages, system, cached))
        return [{"text": answer_text(answer)}]

    def stream(self, messages: list[Message], system: str | None = None) -> Iterator[str]:
        """The whole answer as one piece."""
        text = first_text(self.complete(messages, system))
        if text is not None:
            yield text


@dataclass
class CacheClient:
    """Makes and refreshes remote prompt caches."""

    send: Send = field(repr=False)

    @staticmethod
    def create_body(model: str, system: str, ttl_seconds: int) -> str:
        return json.dumps({"model": f"models/{model}", "systemInstruction": {"parts": [{"text": system}]}, "ttl": f"{ttl_seconds}s"})

    @staticmethod
    def refresh_body(ttl_seconds: int) -> str:
        return json.dumps({"ttl": f"{ttl_seconds}s"})

    def create(self, system: str, model: str, ttl_seconds: int) -> str:
        """The name of a new cache; an answer without one is an error."""
        name = cache_name(self.send("POST", "/cachedContents", self.create_body(model, system, ttl_seconds)))
        if name is None:
            raise ValueError("the answer names no cache")
        return name

    def refresh(self, name: str, ttl_seconds: int) -> None:
        self.send("PATCH", f"/{name}", self.refresh_body(ttl_seconds))


@dataclass
class ExternalExtractor:
    """Facts of an episode by any chat model."""

    chat: ChatModel

    def extract(self, text: str) -> list[dict]:
        answer = first_text(self.chat.complete([("user", [{"text": text}])], system=EXTRACTION_INSTRUCTION))
        return [] if answer is None else decode_facts(answer)


def passing(work: Callable[[], str]) -> str:
    return work()


@dataclass
class LocalExtractor:
    """Facts of an episode by a model in this process.

    ``load`` gives the model and is called before each use; ``serialize`` may
    make uses wait for each other, see :func:`one_at_a_time`.
    """

    load: Callable[[], ChatModel]
    serialize: Callable[[Callable[[], str]], str] = passing

    def extract(self, text: str) -> list[dict]:
        def work() -> str:
            return first_text(self.load().complete([("user", [{"text": text}])], system=EXTRACTION_INSTRUCTION)) or ""

        return decode_facts(self.serialize(work))


def one_at_a_time() -> Callable[[Callable[[], str]], str]:
    """A ``serialize`` that lets one use run at a time within a process."""
    lock = Lock()

    def run(work: Callable[[], str]) -> str:
        with lock:
            return work()

    return run


def make_extractor(settings: MemorySettings, local: LocalExtractor, remote: dict[str, Callable[[str], ChatModel]]) -> LocalExtractor | ExternalExtractor:
    """The extractor that the settings name; local if there is no key or no such client, as extraction never stops a chat.

    ``remote`` gives for each kind how a chat model is made of a key.
    """
    key = settings.key(settings.extraction)
    if settings.extraction == "local" or key is None or settings.extraction not in remote:
        return local
    return ExternalExtractor(remote[settings.extraction](key))


def extraction_of(make: Callable[[], LocalExtractor | ExternalExtractor]) -> Callable[[DataFrame], DataFrame]:
    """What :func:`mnemograph.streaming.ingest_stream.merge_turns` asks: (graph_id, episode_seq, facts) of turns.

    ``make`` is called once in each task, so a client need not be sent along. A
    turn whose extraction fails has no facts.
    """
    schema = T.StructType([T.StructField("graph_id", T.StringType()), T.StructField("episode_seq", T.LongType()), T.StructField("facts", T.ArrayType(EXTRACTED_FACT))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def facts(text: str) -> list[dict]:
            try:
                return model.extract(text)
            except Exception:  # noqa: BLE001  whatever a client raises
                return []

        for b in batches:
            yield pd.DataFrame({"graph_id": b["graph_id"], "episode_seq": b["episode_seq"], "facts": [facts(t) for t in b["text"]]})

    def extract(turns: DataFrame) -> DataFrame:
        text = episode_text(F.col("user_text"), F.col("assistant_text"), F.col("known_user_name"))
        return turns.select("graph_id", "episode_seq", text.alias("text")).mapInPandas(run, schema)

    return extract

"""Calls to a model: retries, JSON replies with one repair, token caps. The transport is a plug-in.

A transport is a callable of one request that returns text or raises ``CallError``. The
scripted one answers from a function, for tests and offline runs.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.plans.settings import TOKEN_CAPS, Settings

BASE_S, CAP_S = 1.0, 30.0


class CallError(Exception):
    def __init__(self, message: str, status: int | None = None, retry_after_s: float | None = None, retryable: bool | None = None) -> None:
        super().__init__(message)
        self.status, self.retry_after_s = status, retry_after_s
        self.retryable = retryable if retryable is not None else status is None or status == 429 or status >= 500


def retry_after(header: str | None) -> float | None:
    """Whole seconds; 0 and anything else say nothing."""
    return float(header) or None if header and re.fullmatch(r"\s*\d+\s*", header) else None


@dataclass
class Request:
    task: str
    system: str
    user: str
    json: bool = False
    max_tokens: int | None = None
    temperature: float | None = None
    images: tuple = ()
    model: str = ""


def unfenced(text: str) -> str:
    m = re.fullmatch(r"```[\w-]*[ \t]*\r?\n(.*?)\r?\n?```", text.strip(), re.S)
    return m[1] if m else text


@dataclass
class Provider:
    transport: Callable[[Request], str]
    settings: Settings = field(default_factory=Settings)
    sleep: Callable[[float], None] = time.sleep
    chance: Callable[[], float] = random.random
    attempts: Counter = field(default_factory=Counter)
    calls: Counter = field(default_factory=Counter)

    def wait(self, failed: int, error: CallError) -> float:
        """Seconds before the next try: what the server asks for, else doubling, half of it by chance."""
        if error.retry_after_s:
            return min(error.retry_after_s, CAP_S)
        whole = min(BASE_S * 2 ** (failed - 1), CAP_S)
        return whole / 2 * (1 + self.chance())

    def _tries(self, r: Request) -> str:
        error = None
        tries = self.settings.max_retries + 1
        for k in range(tries):
            if k:
                self.sleep(self.wait(k, error))
            self.attempts[r.task] += 1
            try:
                return self.transport(r)
            except CallError as e:
                if not e.retryable:
                    raise CallError(f"{r.task}: {e}", e.status, e.retry_after_s, False) from e
                error = e
        raise CallError(f"{r.task}: giving up after {tries} attempt{'s' * (tries != 1)} — {error}", error.status, error.retry_after_s, False)

    def _sent(self, r: Request) -> str:
        try:
            return self._tries(r)
        except CallError as e:  # some models take no temperature: once more without
            if r.temperature is None or e.status != 400 or "temperature" not in str(e).lower():
                raise
        return self._tries(Request(**(r.__dict__ | {"temperature": None})))

    def complete(self, r: Request):  # noqa: ANN201
        """Text, or the parsed reply of a JSON request; a reply that does not parse is asked for once more."""
        self.calls[r.task] += 1
        model = (self.settings.models.get(r.task) or "").strip()
        if not model:
            raise CallError(f"no model configured for task {r.task}", retryable=False)
        cap = TOKEN_CAPS[r.task]
        asked = r.max_tokens if isinstance(r.max_tokens, (int, float)) and 1 <= r.max_tokens < float("inf") else cap
        r = Request(**(r.__dict__ | {"model": model, "max_tokens": min(int(asked), cap), "temperature": 0 if r.json else r.temperature}))
        text = self._sent(r)
        if not r.json:
            return text
        for again in (True, False):
            try:
                return json.loads(unfenced(text))
            except ValueError as e:
                if not again:
                    raise CallError(f"{r.task}: reply was not valid JSON after one repair retry — {e}", retryable=False) from e
                text = self._sent(Request(**(r.__dict__ | {"user": f"{r.user}\n\nYour previous reply could not be parsed as JSON ({e}). Reply again with only valid JSON."})))


WORK = "key string, task string, system string, user string, json boolean, image binary"


def call_all(work: DataFrame, make_provider: Callable[[], Provider], concurrency: int = 2) -> DataFrame:
    """``work(key, task, system, user, json[, image])`` -> ``key, task, reply, error, attempts``, made on the executors.

    The rows are dealt to ``concurrency`` tasks. A failed call costs its own row. Checkpoint
    the result before it is used, so that a task that runs again calls nobody twice.
    """

    def run(batches):
        import pandas as pd

        provider = make_provider()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                reply = error = None
                before = sum(provider.attempts.values())
                try:
                    reply = provider.complete(Request(r.task, r.system, r.user, bool(r.json), images=() if r.image is None else (bytes(r.image),)))
                except CallError as e:
                    error = str(e)
                out.append((r.key, r.task, json.dumps(reply, ensure_ascii=False) if r.json and error is None else reply, error, sum(provider.attempts.values()) - before))
            yield pd.DataFrame(out, columns=["key", "task", "reply", "error", "attempts"]).astype({"attempts": "int64"})

    image = F.col("image") if "image" in work.columns else F.lit(None).cast("binary")
    rows = work.select("key", "task", "system", "user", "json", image.alias("image"))
    return rows.repartition(concurrency, "key").mapInPandas(run, "key string, task string, reply string, error string, attempts long")


def inventory_of(reply) -> tuple[str, list[dict]]:  # noqa: ANN001
    """Summary and items of an inventory reply; malformed items are dropped, a malformed whole is an error."""
    flat = lambda x: " ".join(x.split()) if isinstance(x, str) else ""
    if not isinstance(reply, dict) or not isinstance(reply.get("source_summary"), str) or not isinstance(reply.get("items"), list):
        raise CallError("inventory reply has no source_summary and items", retryable=False)
    items = []
    for x in reply["items"]:
        if isinstance(x, dict) and flat(x.get("title")) and x.get("kind") in ("entity", "concept"):
            names = x.get("aliases")
            names = [names] if isinstance(names, str) else names if isinstance(names, list) else []
            items.append({"title": flat(x["title"]), "kind": x["kind"], "aliases": [n for n in map(flat, names) if n], "summary": flat(x.get("summary"))})
    return flat(reply["source_summary"]), items


def seeds_of(reply, known: set[str], settings: Settings) -> tuple[list[str], list[str]]:  # noqa: ANN001
    """Known seed paths and keywords of a seed reply, each once, within their caps."""
    if not isinstance(reply, dict):
        raise CallError("seed reply was not a JSON object", retryable=False)

    def texts(name: str) -> list[str]:
        own = reply.get(name)
        return list(dict.fromkeys(x.strip() for x in own if isinstance(x, str) and x.strip())) if isinstance(own, list) else []

    return [s for s in texts("seeds") if s in known][: settings.seeds_cap], texts("keywords")[: settings.keywords_cap]


def without_footer(reply: str) -> tuple[str, list[str]]:
    """An answer and the list in the fenced JSON at its very end, which goes whether it parses or not."""
    text = reply.rstrip()
    m = re.search(r"\n?```(?:json)?[ \t]*\r?\n((?:(?!```).)*?)\r?\n?```[ \t]*\Z", text, re.S)
    if not m:
        return text.strip(), []
    try:
        data = json.loads(m[1])
    except ValueError:
        data = None
    listed = data.get("missing_information") if isinstance(data, dict) else None
    return text[: m.start()].strip(), [x for x in listed if isinstance(x, str) and x.strip()] if isinstance(listed, list) else []

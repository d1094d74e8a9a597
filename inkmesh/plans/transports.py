"""Transports over HTTP for :class:`~inkmesh.plans.provider.Provider`: two public request formats.

A transport is a callable of one request. What differs between the formats (place, heads,
body, where the text of a reply is and what says that it was cut) is a ``Wire``; sending,
reading and errors are the same for both. ``post(url, headers, body, seconds)`` returns
``(status, headers, body)`` and may be replaced, as in tests.
"""

from __future__ import annotations

import base64
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

from inkmesh.plans.provider import CallError, Request, retry_after

Post = Callable[[str, dict, bytes, float], tuple[int, dict, bytes]]
#: The address and version of the messages format, and the host that wants the newer name of the token field.
MESSAGES_URL, MESSAGES_VERSION = "https://api.anthropic.com/v1/messages", "2023-06-01"
NEW_FIELD_HOST, OLD_FIELD, NEW_FIELD = "api.openai.com", "max_tokens", "max_completion_tokens"
#: How images begin, and their content types.
IMAGE_HEADS = ((b"\x89PNG", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"RIFF", "image/webp"))


def http_post(url: str, headers: dict, body: bytes, seconds: float) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=seconds) as r:  # noqa: S310 - checked before
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()
    except (OSError, ValueError) as e:
        raise CallError(f"no answer: {e}") from e  # may be tried again


def media_type(raw: bytes) -> str:
    return next((kind for head, kind in IMAGE_HEADS if raw.startswith(head)), "image/png")


@dataclass
class Wire:
    url: str
    headers: dict
    parts: Callable[[Request], list | str]  # what the user says
    body: Callable[[Request, list | str], dict]
    texts: Callable[[dict], list]  # of a reply; raises LookupError or TypeError where there is none
    cut: Callable[[dict], bool]


@dataclass
class Transport:
    wire: Wire
    post: Post = http_post
    seconds: float = 120.0
    token_field: str = OLD_FIELD

    def __call__(self, r: Request) -> str:
        body = self.wire.body(r, self.wire.parts(r)) | {self.token_field: r.max_tokens} | ({} if r.temperature is None else {"temperature": r.temperature})
        status, headers, raw = self.post(self.wire.url, {"content-type": "application/json"} | self.wire.headers, json.dumps(body).encode(), self.seconds)
        if not 200 <= status < 300:
            says = detail(raw)
            if status == 400 and self.token_field == OLD_FIELD and NEW_FIELD in says:
                self.token_field = NEW_FIELD  # from now on: no way back
                return self(r)
            after = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
            raise CallError(f"HTTP {status}: {says}" if says else f"HTTP {status}", status, retry_after(after))
        try:
            reply = json.loads(raw)
            if self.wire.cut(reply):
                raise CallError("the reply was cut at its token limit, so it is not whole", retryable=False)
            return "".join(x for x in self.wire.texts(reply) if isinstance(x, str))
        except (ValueError, LookupError, TypeError, AttributeError) as e:
            raise CallError("the reply is not what this format promises", retryable=False) from e


def detail(raw: bytes) -> str:
    """What an error reply says, on one line, at most 300 characters."""
    text = raw.decode("utf-8", "replace")
    try:
        own = json.loads(text)
        error = own.get("error", own) if isinstance(own, dict) else {}
        text = error if isinstance(error, str) else str(error.get("message", "")) if isinstance(error, dict) else ""
    except ValueError:
        pass
    return " ".join(text.split())[:300]


def messages(key: str, post: Post = http_post, seconds: float = 120.0, url: str = MESSAGES_URL) -> Transport:
    """The messages format. It always wants a key."""
    if not key.strip():
        raise CallError("no API key is set", retryable=False)

    def image(raw: bytes) -> dict:
        return {"type": "image", "source": {"type": "base64", "media_type": media_type(raw), "data": base64.b64encode(raw).decode()}}

    wire = Wire(
        url, {"x-api-key": key, "anthropic-version": MESSAGES_VERSION},
        lambda r: [*map(image, r.images), {"type": "text", "text": r.user}],
        lambda r, parts: {"model": r.model, "system": r.system, "messages": [{"role": "user", "content": parts}]},
        lambda reply: [b.get("text") for b in reply["content"] if b.get("type") == "text"],
        lambda reply: reply.get("stop_reason") == "max_tokens",
    )
    return Transport(wire, post, seconds)


def chat_completions(base_url: str, key: str = "", post: Post = http_post, seconds: float = 120.0) -> Transport:
    """The chat completions format that many servers speak. One of ours may want no key. A bad address is refused before anything is sent."""
    try:
        at = urlsplit(base_url.strip())
        good = at.scheme in ("http", "https") and bool(at.hostname)
        at.port  # noqa: B018 - raises where it is no number
    except ValueError:
        good = False
    if not good:
        raise CallError(f"not an http address: {base_url[:100]}", retryable=False)
    path = re.sub(r"/chat/completions$", "", at.path.rstrip("/")) + "/chat/completions"

    def image(raw: bytes) -> dict:
        return {"type": "image_url", "image_url": {"url": f"data:{media_type(raw)};base64,{base64.b64encode(raw).decode()}"}}

    def texts(reply: dict) -> list:
        said = reply["choices"][0]["message"]["content"]
        return [said] if isinstance(said, str) else [p.get("text") for p in said]

    wire = Wire(
        urlunsplit((at.scheme, at.netloc, path, at.query, "")), {"authorization": f"Bearer {key}"} if key.strip() else {},
        lambda r: [*map(image, r.images), {"type": "text", "text": r.user}] if r.images else r.user,
        lambda r, parts: {"model": r.model, "messages": [{"role": "system", "content": r.system}, {"role": "user", "content": parts}]},
        texts,
        lambda reply: reply["choices"][0].get("finish_reason") == "length",
    )
    return Transport(wire, post, seconds, NEW_FIELD if at.hostname == NEW_FIELD_HOST else OLD_FIELD)

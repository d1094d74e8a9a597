"""Both request formats against a recorded answer: bodies, texts, cut replies, errors, the token field."""

import json

import pytest

from inkmesh.plans import transports as T
from inkmesh.plans.provider import CallError, Provider, Request


class Server:
    def __init__(self, *answers):
        self.answers, self.got = list(answers), []

    def __call__(self, url, headers, body, seconds):
        self.got.append((url, headers, json.loads(body)))
        status, out, *more = self.answers.pop(0)
        return status, more[0] if more else {}, out if isinstance(out, bytes) else json.dumps(out).encode()


REQUEST = Request("synthesis", "sys", "hello", max_tokens=9, model="m", temperature=0, images=(b"\xff\xd8x",))


def test_messages():
    s = Server((200, {"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}], "stop_reason": "end_turn"}), (200, {"content": [], "stop_reason": "max_tokens"}), (200, b"<html>"))
    t = T.messages("k", s)
    assert t(REQUEST) == "ab"
    url, headers, body = s.got[0]
    assert url == T.MESSAGES_URL and headers["x-api-key"] == "k" and body["max_tokens"] == 9 and body["temperature"] == 0 and body["system"] == "sys"
    assert [p["type"] for p in body["messages"][0]["content"]] == ["image", "text"] and body["messages"][0]["content"][0]["source"]["media_type"] == "image/jpeg"
    for says in ("cut at its token limit", "not what this format"):
        with pytest.raises(CallError, match=says) as e:
            t(REQUEST)
        assert not e.value.retryable
    with pytest.raises(CallError, match="no API key"):
        T.messages(" ")


def test_chat_completions():
    ok = (200, {"choices": [{"message": {"content": [{"text": "x"}, {"text": "y"}]}, "finish_reason": "stop"}]})
    s = Server((400, {"error": {"message": "use max_completion_tokens instead"}}), ok, ok, (200, {"choices": [{"message": {"content": "z"}, "finish_reason": "length"}]}), (200, {"choices": []}))
    t = T.chat_completions("http://localhost:1/v1/?a=b", post=s)
    assert t(REQUEST) == "xy" and t(Request("synthesis", "", "u", model="m")) == "xy"
    assert s.got[0][0] == "http://localhost:1/v1/chat/completions?a=b" and "authorization" not in s.got[0][1]
    assert "max_tokens" in s.got[0][2] and all("max_completion_tokens" in b and "max_tokens" not in b for _, _, b in s.got[1:])
    assert s.got[2][2]["messages"][1]["content"] == "u" and "temperature" not in s.got[2][2]
    for says in ("cut at its token limit", "not what this format"):
        with pytest.raises(CallError, match=says):
            t(REQUEST)
    assert T.chat_completions("https://api.openai.com/v1/chat/completions", "k").token_field == T.NEW_FIELD
    assert T.chat_completions("https://api.openai.com/v1/chat/completions", "k").wire.url.endswith("/v1/chat/completions")


@pytest.mark.parametrize("url", ["", "localhost:1", "ftp://x/", "http://", "http://x:port/"])
def test_bad_addresses_are_refused_before_a_request(url):
    with pytest.raises(CallError, match="not an http address"):
        T.chat_completions(url, post=Server())


def test_errors_are_told_and_tried_again():
    s = Server((429, {"error": {"message": "slow\ndown"}}, {"Retry-After": "7"}), (503, b"busy"), (200, {"content": [{"type": "text", "text": "ok"}]}))
    waits = []
    assert Provider(T.messages("k", s), sleep=waits.append, chance=lambda: 1.0).complete(Request("synthesis", "", "")) == "ok" and waits == [7, 2.0]
    with pytest.raises(CallError, match="HTTP 401: no") as e:
        T.messages("k", Server((401, {"error": "no"})))(REQUEST)
    assert e.value.status == 401 and not e.value.retryable
    with pytest.raises(CallError, match="no answer"):
        T.http_post("http://127.0.0.1:1/", {}, b"", 0.5)

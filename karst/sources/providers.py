"""Model providers behind the completer interface, over a transport that can be replaced.

A transport is any picklable function (url, headers, body, timeout) -> (status, text).  A provider knows how one
service wants its requests and says its replies; what goes wrong is told in one form, so that failures can be
classified later.  Completers are built from settings, with their credentials checked first.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from karst.settings import Settings
from karst.sources.structured import strict_schema

Transport = Callable[[str, dict, bytes, float], tuple[int, str]]
#: Characters of an error's detail that are kept.
DETAIL = 4000


class ProviderError(RuntimeError):
    """A request that a service did not answer."""


def http_transport(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, str]:
    """The standard library's HTTP; answers with an error status are answers."""
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def error_detail(text: str | None) -> str:
    """What an error reply says: its ``detail`` or ``error`` as text, or else all of it, cut to DETAIL characters."""
    try:
        found = json.loads(text or "")
        for key in ("detail", "error", "message"):
            if isinstance(found, dict) and found.get(key):
                found = found[key]
                break
        text = found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)
    except ValueError:
        pass
    return (text or "").strip()[:DETAIL]


def post_json(url: str, payload: dict, *, timeout: float = 60.0, headers: dict | None = None, transport: Transport = http_transport) -> dict:
    """One POST: status, seconds, value (the JSON object) and error (null, timeout, connection, http or malformed) with its detail."""
    began, value, error, detail, status = time.monotonic(), None, None, None, None
    try:
        status, text = transport(url, headers or {}, json.dumps(payload, ensure_ascii=False).encode(), timeout)
        if status >= 400:
            error, detail = "http", error_detail(text)
        else:
            value = json.loads(text)
            if not isinstance(value, dict):
                value, error, detail = None, "malformed", "the reply is no JSON object"
    except ValueError as e:
        error, detail = "malformed", str(e)[:DETAIL]
    except (TimeoutError, OSError) as e:
        late = isinstance(e, TimeoutError) or "timed out" in str(e)
        error, detail = "timeout" if late else "connection", f"{type(e).__name__}: {e}"[:DETAIL]
    return {"status": status, "seconds": time.monotonic() - began, "value": value, "error": error, "detail": detail}


def connect(open_client: Callable, ready: Callable = bool, *, attempts: int = 5, delay: float = 2.0, sleep: Callable = time.sleep):
    """open_client() once it is ready; an attempt that fails is closed and made again after a fixed delay, and the last failure is raised."""
    if attempts < 1:
        raise ValueError("at least one attempt is needed")
    last: Exception | None = None
    for k in range(attempts):
        client = None
        try:
            client = open_client()
            if ready(client):
                return client
            last = ConnectionError("the service is not ready")
        except Exception as e:
            last = e
        if client is not None and hasattr(client, "close"):
            client.close()
        if k + 1 < attempts:
            sleep(delay)
    raise ConnectionError(f"no connection after {attempts} attempts") from last


def lenient_json(text: str) -> str:
    """The JSON of a reply that holds raw control characters inside its strings, or stands in a code fence."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    return json.dumps(json.loads((fenced[1] if fenced else text).strip(), strict=False), ensure_ascii=False)


@dataclass(frozen=True)
class Provider:
    """How a service is asked.  body(model, request, schema) -> dict; reply(value) -> (text, input tokens, output tokens, why it stopped)."""

    name: str
    url: str
    key_variable: str | None
    headers: Callable[[str], dict]
    body: Callable[[str, dict, dict | None], dict]
    reply: Callable[[dict], tuple[str, int, int, str | None]]
    cut_off: tuple[str, ...] = ("length", "max_tokens", "MAX_TOKENS", "max_output_tokens")
    refused: tuple[str, ...] = ()
    most_tokens: int | None = None
    lenient: bool = False


def _bearer(key: str) -> dict:
    return {"Authorization": f"Bearer {key}"}


def _chat(model: str, r: dict, schema: dict | None) -> dict:
    out = {"model": model, "max_tokens": r["max_output_tokens"], "messages": [{"role": "system", "content": r["instructions"]}, {"role": "user", "content": r["payload"]}]}
    return out | ({"response_format": {"type": "json_schema", "json_schema": {"name": r["stage"], "strict": True, "schema": schema}}} if schema else {"response_format": {"type": "json_object"}})


def _chat_reply(v: dict) -> tuple[str, int, int, str | None]:
    choice, used = (v.get("choices") or [{}])[0], v.get("usage") or {}
    return (choice.get("message") or {}).get("content") or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0), choice.get("finish_reason")


def _responses(model: str, r: dict, schema: dict | None) -> dict:
    form = {"type": "json_schema", "name": r["stage"], "strict": True, "schema": schema} if schema else {"type": "json_object"}
    return {"model": model, "instructions": r["instructions"], "input": r["payload"], "max_output_tokens": r["max_output_tokens"], "text": {"format": form}}


def _responses_reply(v: dict) -> tuple[str, int, int, str | None]:
    text = "".join(c.get("text", "") for item in v.get("output") or [] for c in item.get("content") or [] if c.get("type") == "output_text")
    used = v.get("usage") or {}
    return text, used.get("input_tokens", 0), used.get("output_tokens", 0), (v.get("incomplete_details") or {}).get("reason")


def _messages(model: str, r: dict, schema: dict | None) -> dict:
    out = {"model": model, "max_tokens": r["max_output_tokens"], "system": r["instructions"], "messages": [{"role": "user", "content": r["payload"]}]}
    return out | ({"tools": [{"name": r["stage"], "input_schema": schema}], "tool_choice": {"type": "tool", "name": r["stage"]}} if schema else {})


def _messages_reply(v: dict) -> tuple[str, int, int, str | None]:
    parts, used = v.get("content") or [], v.get("usage") or {}
    tool = next((p["input"] for p in parts if p.get("type") == "tool_use"), None)
    text = json.dumps(tool, ensure_ascii=False) if tool is not None else "".join(p.get("text", "") for p in parts if p.get("type") == "text")
    return text, used.get("input_tokens", 0), used.get("output_tokens", 0), v.get("stop_reason")


def _contents(model: str, r: dict, schema: dict | None) -> dict:
    config = {"maxOutputTokens": r["max_output_tokens"], "responseMimeType": "application/json"} | ({"responseJsonSchema": schema} if schema else {})
    return {"systemInstruction": {"parts": [{"text": r["instructions"]}]}, "contents": [{"role": "user", "parts": [{"text": r["payload"]}]}], "generationConfig": config}


def _contents_reply(v: dict) -> tuple[str, int, int, str | None]:
    best, used = (v.get("candidates") or [{}])[0], v.get("usageMetadata") or {}
    text = "".join(p.get("text", "") for p in (best.get("content") or {}).get("parts") or [])
    blocked = (v.get("promptFeedback") or {}).get("blockReason")
    return text, used.get("promptTokenCount", 0), used.get("candidatesTokenCount", 0), blocked or best.get("finishReason")


def _chat2_reply(v: dict) -> tuple[str, int, int, str | None]:
    used = (v.get("usage") or {}).get("tokens") or {}
    text = "".join(c.get("text", "") for c in (v.get("message") or {}).get("content") or [])
    return text, used.get("input_tokens", 0), used.get("output_tokens", 0), v.get("finish_reason")


def _chat2(model: str, r: dict, schema: dict | None) -> dict:
    out = _chat(model, r, None)
    return out | {"response_format": {"type": "json_object"} | ({"json_schema": schema} if schema else {})}


def _local(model: str, r: dict, schema: dict | None) -> dict:
    return {"model": model, "stream": False, "format": schema or "json", "options": {"num_predict": r["max_output_tokens"]}, "messages": _chat(model, r, None)["messages"]}


def _local_reply(v: dict) -> tuple[str, int, int, str | None]:
    return (v.get("message") or {}).get("content") or "", v.get("prompt_eval_count", 0), v.get("eval_count", 0), v.get("done_reason")


PROVIDERS = {
    p.name: p
    for p in (
        Provider("openai", "https://api.openai.com/v1/responses", "OPENAI_API_KEY", _bearer, _responses, _responses_reply),
        Provider("anthropic", "https://api.anthropic.com/v1/messages", "ANTHROPIC_API_KEY", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"}, _messages, _messages_reply),
        Provider("google", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "GOOGLE_API_KEY", lambda k: {"x-goog-api-key": k}, _contents, _contents_reply, refused=("SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST")),
        Provider("opencode", "https://opencode.ai/zen/v1/chat/completions", "OPENCODE_API_KEY", _bearer, _chat, _chat_reply),
        Provider("cohere", "https://api.cohere.com/v2/chat", "COHERE_API_KEY", _bearer, _chat2, _chat2_reply, most_tokens=4000, lenient=True),
        Provider("ollama", "http://localhost:11434/api/chat", None, lambda k: {}, _local, _local_reply),
    )
}


@dataclass(frozen=True)
class Completer:
    """A completer of one provider and model; schemas: JSON schemas by stage."""

    provider: str
    model: str
    key: str = ""
    url: str | None = None
    timeout: float = 120.0
    schemas: tuple[tuple[str, str], ...] = ()
    transport: Transport = http_transport

    def __call__(self, requests: list[dict]) -> list[dict]:
        return [self._one(r) for r in requests]

    def _one(self, request: dict) -> dict:
        p = PROVIDERS[self.provider]
        limit = min(request["max_output_tokens"], p.most_tokens or request["max_output_tokens"])
        schema = dict(self.schemas).get(request["stage"])
        body = p.body(self.model, request | {"max_output_tokens": limit}, strict_schema(json.loads(schema)) if schema else None)
        got = post_json((self.url or p.url).replace("{model}", self.model), body, timeout=self.timeout, headers=p.headers(self.key), transport=self.transport)
        if got["error"]:
            raise ProviderError(f"{p.name} request failed. status={got['status']} error={got['error']}: {got['detail']}")
        text, used_in, used_out, stopped = p.reply(got["value"])
        if p.lenient and text.strip():
            text = lenient_json(text)
        return {"text": text, "input_tokens": used_in, "output_tokens": used_out, "cut_off": stopped in p.cut_off, "refused": stopped in p.refused}


def build_completer(s: Settings, *, schemas: dict[str, dict] | None = None, environ: dict[str, str] | None = None, transport: Transport = http_transport) -> Completer:
    """The completer of the settings' provider and model; an unknown provider, no model and a missing key are errors before any call."""
    if s.llm_provider not in PROVIDERS:
        raise ValueError(f"unknown provider {s.llm_provider!r}; known are {', '.join(PROVIDERS)}")
    if not s.llm_model.strip() or s.llm_model == "recorded":
        raise ValueError("a model must be named")
    variable = PROVIDERS[s.llm_provider].key_variable
    key = (os.environ if environ is None else environ).get(variable, "").strip() if variable else ""
    if variable and not key:
        raise ValueError(f"{variable} is not set")
    return Completer(s.llm_provider, s.llm_model, key, schemas=tuple((k, json.dumps(v)) for k, v in (schemas or {}).items()), transport=transport)


@dataclass(frozen=True)
class HttpEmbedder:
    """Embeddings by an OpenAI-style service: texts -> vectors, in order."""

    url: str
    model: str
    key: str = ""
    timeout: float = 120.0
    transport: Transport = http_transport

    def __call__(self, texts: list[str]) -> list[list[float]]:
        got = post_json(self.url, {"model": self.model, "input": texts}, timeout=self.timeout, headers=_bearer(self.key) if self.key else {}, transport=self.transport)
        if got["error"]:
            raise ProviderError(f"embedding request failed. status={got['status']} error={got['error']}: {got['detail']}")
        rows = sorted(got["value"].get("data") or [], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ProviderError(f"{len(texts)} texts were sent, {len(rows)} vectors came")
        return [r["embedding"] for r in rows]

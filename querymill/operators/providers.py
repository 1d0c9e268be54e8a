"""Model providers over HTTP, each a function of a prompt, and the stub that needs no network.

A provider is a dict with a name (openai, anthropic, gemini, ollama or stub), models, and where needed
base_url, api_key (or api_keys, a list), timeout, temperature and max_tokens. Calls are made in the
tasks; what a task remembers between calls, the key in use, lives in its worker.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from querymill.operators.judge import stub

#: Where the providers answer, and how many seconds they are given.
BASES = {"openai": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com", "gemini": "https://generativelanguage.googleapis.com", "ollama": "http://localhost:11434"}
TIMEOUTS = {"openai": 120.0, "anthropic": 120.0, "gemini": 120.0, "ollama": 600.0}
#: Answers after which the next key is tried.
EXHAUSTED = (401, 403, 429)

_key_in_use: dict[str, int] = {}


def post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def _keys(provider: dict) -> list[str]:
    return list(provider.get("api_keys") or ([provider["api_key"]] if provider.get("api_key") else []))


def rotated(provider: dict, ask: Callable[[str], dict]) -> dict:
    """ask(key) with the key in use; keys that are exhausted are passed over, each at most once a call."""
    keys = _keys(provider)
    if not keys:
        raise ValueError(f"provider {provider['name']} has no api_key")
    start = _key_in_use.get(provider["name"], 0)
    for i in range(len(keys)):
        at = (start + i) % len(keys)
        try:
            answer = ask(keys[at])
            _key_in_use[provider["name"]] = at
            return answer
        except urllib.error.HTTPError as e:
            if e.code not in EXHAUSTED or i == len(keys) - 1:
                raise
    raise AssertionError("unreachable")


def _openai(p: dict, model: str, text: str, temperature: float) -> str:
    body = {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": text}]}
    return rotated(p, lambda key: post(f"{p['base_url']}/chat/completions", body, {"Authorization": f"Bearer {key}"}, p["timeout"]))["choices"][0]["message"]["content"]


def _anthropic(p: dict, model: str, text: str, temperature: float) -> str:
    body = {"model": model, "max_tokens": p.get("max_tokens", 4096), "messages": [{"role": "user", "content": text}]}

    def ask(key: str) -> dict:
        headers = {"x-api-key": key, "anthropic-version": "2023-06-01"}
        try:
            return post(f"{p['base_url']}/v1/messages", body | {"temperature": temperature}, headers, p["timeout"])
        except urllib.error.HTTPError as e:
            if e.code != 400:
                raise
            return post(f"{p['base_url']}/v1/messages", body, headers, p["timeout"])  # a model that takes no temperature

    return "".join(part.get("text", "") for part in rotated(p, ask)["content"])


def _gemini(p: dict, model: str, text: str, temperature: float) -> str:
    body = {"contents": [{"parts": [{"text": text}]}], "generationConfig": {"temperature": temperature}}
    answer = rotated(p, lambda key: post(f"{p['base_url']}/v1beta/models/{model}:generateContent", body, {"x-goog-api-key": key}, p["timeout"]))
    return "".join(part.get("text", "") for part in answer["candidates"][0]["content"]["parts"])


def _ollama(p: dict, model: str, text: str, temperature: float) -> str:
    body = {"model": model, "stream": False, "options": {"temperature": temperature}, "messages": [{"role": "user", "content": text}]}
    return post(f"{p['base_url']}/api/chat", body, {}, p["timeout"])["message"]["content"]


_CALLS = {"openai": _openai, "anthropic": _anthropic, "gemini": _gemini, "ollama": _ollama}


def caller(providers: list[dict], voters: list[dict]) -> Callable[[str, str, str], str]:
    """(provider, model, prompt) → reply. A provider that nothing here answers for is refused: only one named stub is a stub."""
    known: dict[str, dict] = {}
    for p in providers:
        name = str(p.get("name", "")).lower()
        if name == "stub":
            continue
        if name not in _CALLS:
            raise ValueError(f"no provider {name!r}; there are {', '.join([*_CALLS, 'stub'])}")
        known[name] = p | {"name": name, "base_url": (p.get("base_url") or BASES[name]).rstrip("/"), "timeout": float(p.get("timeout") or TIMEOUTS[name])}
    for v in voters:
        if v["provider"] != "stub" and v["provider"] not in known:
            raise ValueError(f"voter {v['model']!r} names a provider that isn't configured: {v['provider']!r}")
    temperature = {(v["provider"], v["model"]): float(v.get("temperature", 0.0)) for v in voters}

    def call(provider: str, model: str, text: str) -> str:
        if provider == "stub":
            return stub(provider, model, text)
        return _CALLS[provider](known[provider], model, text, temperature.get((provider, model), 0.0))

    return call

"""Services outside of Spark: embeddings over HTTP, JSON of a command.

An embedding service is a provider like any other: a function from texts to vectors,
which ``operators.semantic.embed`` calls in batches on the executors.
"""

from __future__ import annotations

import json
import os
import subprocess
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from codeloom.operators import semantic


@dataclass(frozen=True)
class HttpEmbeddings:
    """POSTs {"model", "input"} and reads vectors.

    Answers are {"data": [{"index", "embedding"}]}, put in order of index, or
    {"embeddings": [...]} in the order of the texts.
    """

    url: str
    model: str
    key: str | None = None
    timeout: float = 30.0

    def __post_init__(self) -> None:
        if not self.url.startswith(("http://", "https://")):
            raise ValueError(f"not an HTTP address: {self.url!r}")
        if not self.model:
            raise ValueError("a model is needed")

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": [t or "" for t in texts]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as reply:
            return vectors_of(json.loads(reply.read()), len(texts))


def vectors_of(answer: dict, n: int) -> list[np.ndarray]:
    """``n`` vectors of equal length in the order of the texts; anything else is a ValueError."""
    if "data" in answer:
        rows = answer["data"]
        if sorted(r.get("index") for r in rows) != list(range(n)):
            raise ValueError("indices of the answer are not those of the texts")
        found = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
    else:
        found = answer.get("embeddings") or []
    if len(found) != n:
        raise ValueError(f"{len(found)} vectors for {n} texts")
    if len({len(v) for v in found}) > 1 or not found[0]:
        raise ValueError("vectors of different or no length")
    return [np.asarray(v, np.float32) for v in found]


def provider_from_env(env: dict[str, str] | None = None) -> tuple[str, str, Callable] | None:
    """(name, model, function) of CODELOOM_EMBEDDINGS: unset or 'disabled' is none, 'local-hash', or 'http' with its URL, MODEL and KEY."""
    env = dict(os.environ) if env is None else env
    name = env.get("CODELOOM_EMBEDDINGS", "disabled")
    if name == "disabled":
        return None
    if name == "local-hash":
        return (name, *semantic.PROVIDERS[name])
    if name == "http":
        model = env.get("CODELOOM_EMBEDDINGS_MODEL", "")
        return name, model, HttpEmbeddings(env.get("CODELOOM_EMBEDDINGS_URL", ""), model, env.get("CODELOOM_EMBEDDINGS_KEY"), float(env.get("CODELOOM_EMBEDDINGS_TIMEOUT", "30")))
    raise ValueError(f"unknown provider {name!r}")


def batch_size(env: dict[str, str] | None = None) -> int:
    raw = (dict(os.environ) if env is None else env).get("CODELOOM_EMBEDDINGS_BATCH", str(semantic.BATCH))
    if not raw.isdigit() or int(raw) < 1:
        raise ValueError("the batch size must be at least 1")
    return int(raw)


def command_json(arguments: list[str], deadline: float = 30.0) -> object:
    """JSON that a command prints; killed at the deadline. Failures are ValueErrors with what it said."""
    try:
        got = subprocess.run(arguments, capture_output=True, timeout=deadline)
    except (subprocess.TimeoutExpired, OSError) as e:
        raise ValueError(f"{arguments[0]}: {e}") from e
    if got.returncode:
        raise ValueError(f"{arguments[0]} ended with {got.returncode}: {got.stderr.decode(errors='replace')[-500:]}")
    try:
        return unwrap(json.loads(got.stdout))
    except json.JSONDecodeError as e:
        raise ValueError(f"{arguments[0]}: {e}") from e


def unwrap(value: object, depth: int = 4) -> object:
    """The payload inside wrappers: result, structuredContent, or JSON text in content, at most ``depth`` deep."""
    for _ in range(depth):
        if not isinstance(value, dict):
            break
        if isinstance(value.get("result"), (dict, list)):
            value = value["result"]
        elif isinstance(value.get("structuredContent"), (dict, list)):
            value = value["structuredContent"]
        elif isinstance(value.get("content"), list) and value["content"] and isinstance(value["content"][0], dict) and "text" in value["content"][0]:
            try:
                value = json.loads(value["content"][0]["text"])
            except (TypeError, json.JSONDecodeError):
                break
        else:
            break
    return value


def search_pattern(terms: list[str]) -> str | None:
    """The one term to look for: with a separator, then with upper case, then the longest; the last of equals."""
    best = None
    for t in terms:
        rank = (any(c in t for c in "_-./:"), any(c.isupper() for c in t), len(t))
        if best is None or rank >= best[0]:
            best = (rank, t)
    return best[1] if best else None

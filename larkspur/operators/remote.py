"""A named-entity model behind a URL as a plug-in."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from larkspur.operators.backends import SpanPlugin


def ask(url: str, model_id: str, text: str, api_key: str | None = None, timeout: float = 30.0, batch_size: int = 1) -> list[dict]:
    """The entities that a remote model finds in a text: a list, or one under predictions or results."""
    body = {"model_id": model_id, "task": "ner", "text": text, "aggregation_strategy": "first", "batch_size": batch_size}
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            told = json.loads(answer.read().decode())
    except (urllib.error.URLError, json.JSONDecodeError) as error:
        raise RuntimeError(f"the remote model at {url} gave no usable answer: {error}") from error
    found = told if isinstance(told, list) else next((told[k] for k in ("predictions", "results") if isinstance(told, dict) and isinstance(told.get(k), list)), None)
    if found is None:
        raise RuntimeError(f"the remote model at {url} gave no list of entities")
    return found


def remote_plugin(url: str, model_id: str, domain: str = "general", api_key: str | None = None, timeout: float = 30.0, batch_size: int = 1, threshold: float = 0.0) -> SpanPlugin:
    """A plug-in that asks a remote model about each text; domain general or medical says how its labels are read."""
    if not url:
        raise ValueError("remote models need a URL")

    def detect(_, texts: list[str]) -> list[list[tuple]]:
        out = []
        for text in texts:
            items = ask(url, model_id, text, api_key, timeout, batch_size) if text.strip() else []
            out.append([(int(x["start"]), int(x["end"]), x.get("entity_group") or x.get("label") or "", float(x.get("score", x.get("confidence", 0.0)))) for x in items if x.get("start") is not None and x.get("end") is not None])
        return out

    return SpanPlugin(f"remote:{model_id}", detect, labels="medical" if domain == "medical" else "conll", threshold=threshold)

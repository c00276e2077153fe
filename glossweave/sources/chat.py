"""A chat endpoint of a local language model."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

TIMEOUT = 180


class ChatError(RuntimeError):
    """The endpoint can't be reached, or lacks the model."""


def chat(host: str, model: str, messages: list[dict], tools: list[dict] | None = None, timeout: float = TIMEOUT) -> dict:
    """The reply of one turn. Other answers of the endpoint than success or a missing model are raised as they are."""
    body = json.dumps({"model": model, "messages": messages, "tools": tools or [], "stream": False}).encode()
    request = urllib.request.Request(f"{host.rstrip('/')}/api/chat", body, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as error:
        if error.code == 404:
            raise ChatError(f"the endpoint has no model {model!r}") from error
        raise
    except OSError as error:
        raise ChatError(f"no answer from {host}: {error}") from error


def tool_calls(reply: dict) -> list[tuple[str, dict]]:
    """(name, arguments) of the tool calls of a reply; arguments may come as JSON text."""
    out = []
    for call in (reply.get("message") or {}).get("tool_calls") or []:
        function = call.get("function") or {}
        arguments = function.get("arguments") or {}
        out.append((function.get("name"), json.loads(arguments) if isinstance(arguments, str) else arguments))
    return out

"""One strict reading of model replies, shared by parsing, validation and the model step.

A reply is cleaned of its code fence and must be exactly one JSON object in the
standard's sense (double quotes, no bare constants such as NaN, nothing after it)
that holds the required fields. Of repeated keys the last one counts.
"""

from __future__ import annotations

import json

from kbweave.config import REQUIRED_ENTRY_FIELDS

FENCE = "```"


def clean(reply: str) -> str:
    """A reply that starts with a fence loses every line that does."""
    if not reply.startswith(FENCE):
        return reply
    return "\n".join(x for x in reply.split("\n") if not x.startswith(FENCE))


def _refuse(name: str):
    raise ValueError(f"constant {name}")


def read(text: str) -> tuple[str, dict | None]:
    """``(status, object)``: status is ok, bad_json, not_object or missing_fields."""
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return "bad_json", None
    if not isinstance(value, dict):
        return "not_object", None
    return ("ok" if all(f in value for f in REQUIRED_ENTRY_FIELDS) else "missing_fields"), value


def _text(x) -> str | None:
    """A field as text: other values than strings as compact JSON, null as null."""
    if x is None:
        return None
    s = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return s.encode("utf-8", "replace").decode("utf-8")       # half of a surrogate pair is no character


def entry(value: dict) -> dict:
    """Title, content and links of a read object; links that are no list are null, and a
    link that is no object has neither text nor url."""
    links = value.get("links")
    if isinstance(links, list):
        links = [{"text": _text(x.get("text")), "url": _text(x.get("url"))} if isinstance(x, dict) else {"text": None, "url": None}
                 for x in links]
    else:
        links = None
    return {"title": _text(value.get("title")), "content": _text(value.get("content")), "links": links}

"""JSON texts edited in place: what is not replaced stays byte for byte, with its order, spaces and forms of numbers."""

import json
import re

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def places(text: str, deepest: int = 5) -> dict[tuple, tuple[int, int]]:
    """Ranges of the values of a JSON text by path (keys and numbers), down to ``deepest`` steps; of equal keys the last counts."""
    out: dict[tuple, tuple[int, int]] = {}
    path: list = []  # the step of each open object or array
    begins: list[tuple[tuple, int]] = []
    key_next = False
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token in "{[":
            begins.append((tuple(path), m.start()))
            path.append(None if token == "{" else 0)
            key_next = token == "{"
        elif token in "}]":
            path.pop()
            where, start = begins.pop()
            if len(where) <= deepest:
                out[where] = (start, m.end())
            key_next = False
        elif token == ",":
            if isinstance(path[-1], int):
                path[-1] += 1
            else:
                key_next = True
        elif token == ":":
            key_next = False
        elif key_next:
            path[-1] = json.loads(token, strict=False)
            for old in [p for p in out if p[: len(path)] == tuple(path)]:
                del out[old]
        elif len(path) <= deepest:
            out[tuple(path)] = (m.start(), m.end())
    return out


def edited(text: str, values: dict[tuple, str], merged: dict[str, str], into: str) -> str:
    """``text``, a JSON object, with strings ``values`` at some paths, and JSON texts ``merged`` as keys of its object ``into``.

    A path that is not there is left out. ``into`` is made where it is missing or no object; keys that it has already get
    their new values in place.
    """
    found = places(text)
    changes = [(*found[p], json.dumps(v, ensure_ascii=False)) for p, v in values.items() if p in found]

    def object_with(pairs):
        return "{" + ", ".join(f"{json.dumps(k)}: {v}" for k, v in pairs) + "}"

    def inserted(end, empty, body):  # before the closing brace at end - 1
        return (end - 1, end - 1, body if empty else f", {body}")

    if merged:
        at = found.get((into,))
        if at and text[at[0]] == "{":
            fresh = []
            for k, v in merged.items():
                if (into, k) in found:
                    changes.append((*found[into, k], v))
                else:
                    fresh.append((k, v))
            if fresh:
                empty = not text[at[0] + 1 : at[1] - 1].strip()
                changes.append(inserted(at[1], empty, object_with(fresh)[1:-1]))
        elif at:
            changes.append((*at, object_with(merged.items())))
        else:
            start, end = found[()]
            changes.append(inserted(end, not text[start + 1 : end - 1].strip(), f"{json.dumps(into)}: {object_with(merged.items())}"))
    for start, end, new in sorted(changes, reverse=True):
        text = text[:start] + new + text[end:]
    return text

"""Tool calls compared value by value in plain Python: what the expressions are held against."""

import json

from verdigris.operators.toolcalls import CANONICAL, TOLERANCE


def alike(want: object, got: object) -> bool:
    """Equality with numbers in text form taken as numbers, a relative tolerance, ordered lists and unordered objects."""
    if want is None or got is None:
        return want is got
    if isinstance(want, dict) and isinstance(got, dict):
        return want.keys() == got.keys() and all(alike(v, got[k]) for k, v in want.items())
    if isinstance(want, list) and isinstance(got, list):
        return len(want) == len(got) and all(map(alike, want, got))
    if isinstance(want, type(got)) and isinstance(got, type(want)) and not isinstance(want, float):
        return want == got
    if {type(want), type(got)} <= {int, float, bool, str}:
        try:
            a, b = float(want), float(got)  # type: ignore[arg-type]
        except ValueError:
            return False
        return abs(b) <= TOLERANCE if a == 0 else abs(a - b) <= TOLERANCE * abs(a)
    return False


def no_json(word: str) -> None:
    """NaN and Infinity, which Python reads, aren't JSON."""
    raise ValueError(word)


def parse_calls(text: str | None) -> tuple[str | None, list[tuple[str, dict]]]:
    """An error code or the calls: a list, one call, or an object with ``tool_calls``; names may be ``tool_name`` or ``name``."""
    try:
        value = json.loads(text or "", parse_constant=no_json)
    except ValueError:
        return "INVALID_JSON", []
    if isinstance(value, dict):
        value = value["tool_calls"] if "tool_calls" in value else [value]
    if not isinstance(value, list):
        return "SCHEMA_VIOLATION", []
    calls = []
    for call in value:
        name = (call.get("tool_name") or call.get("name")) if isinstance(call, dict) else None
        arguments = call.get("arguments", {}) if isinstance(call, dict) else None
        if not isinstance(name, str) or not isinstance(arguments, dict):
            return "SCHEMA_VIOLATION", []
        calls.append((CANONICAL.get(name, name), arguments))
    return None, calls


def compare(want: list[tuple[str, dict]], got: list[tuple[str, dict]]) -> tuple[float, int, int, int]:
    """(score, missing, extra, calls with differing arguments). Expected calls choose in order: a perfect match if there is
    one, else the first free call of the same name. An expected call that equals a matched one isn't missing."""
    free = dict(enumerate(got))
    matched, differing = [], 0
    for name, arguments in want:
        same = [i for i, (n, _) in free.items() if n == name]
        if not same:
            continue
        best = next((i for i in same if alike(arguments, free[i][1])), None)
        differing += best is None
        del free[same[0] if best is None else best]
        matched.append((name, arguments))
    missing = sum(call not in matched for call in want)
    size = max(len(want), len(got))
    score = (1.0 if not size else 0.0) if not want else max(0.0, (len(matched) - differing) / size)
    return score, missing, len(free), differing


def argument_diff(want: dict, got: dict) -> dict[str, list[str]]:
    """The keys that got lacks, those that only got has, and those whose values differ, each in order."""
    shared = want.keys() & got.keys()
    parts = {"missing_keys": want.keys() - got.keys(), "extra_keys": got.keys() - want.keys(), "value_diffs": {k for k in shared if not alike(want[k], got[k])}}
    return {name: sorted(keys) for name, keys in parts.items() if keys}


def _object(text: str | None) -> dict | None:
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None

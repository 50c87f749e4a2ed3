"""Deterministic offline annotators (stand-ins for a model service).

Each maps one prompt to one reply from the md5 of the prompt, so the whole
annotation flow runs and is testable without a network, and the same rule can
be written in SQL. They also produce the failure kinds a real service does
(failed calls, missing keys, unknown tags). A real annotator is any function
``str -> str`` (or ``pd.Series -> pd.Series`` with ``vectorized=True``).
"""

from __future__ import annotations

import hashlib
import re

from ..constants import FAILED, FIRST_LEVEL_TAGS

_FIRST = re.compile(r"First-level tag: ([^\n]*)")


def _h(prompt: str) -> str:
    return hashlib.md5(prompt.encode("utf-8")).hexdigest()


def _name(h: str) -> str:
    return FIRST_LEVEL_TAGS[int(h[1:3], 16) % 21]


def rate_rule(prompt: str) -> str:
    h = _h(prompt)
    if h[0] == "0":
        return FAILED
    choice = "1" if h[1] in "01234567" else "2"
    return f"Choice: {choice}\nWhy: rule {h[2:6]}"


def summary_rule(prompt: str) -> str:
    h = _h(prompt)
    if h[0] == "0":
        return FAILED
    if h[0] == "1":
        return '{"note": "none"}'
    return '{"summary": "digest ' + h[:8] + '"}'


def first_level_rule(prompt: str) -> str:
    h = _h(prompt)
    if h[0] == "0":
        return FAILED
    if h[0] == "1":
        return '{"tag": "Cooking", "explanation": "rule"}'
    return '{"tag": "' + _name(h) + '", "explanation": "rule"}'


def second_third_rule(prompt: str) -> str:
    h = _h(prompt)
    if h[0] == "0":
        return FAILED
    m = _FIRST.search(prompt)
    f = m.group(1) if m else ""
    second = f"{f[:1].upper()}{f[1:]} s{int(h[1], 16) % 5}"
    third = f"{second} t{int(h[2], 16) % 4}"
    return ('{"second_level_tag": "' + second + '", "third_level_tag": "' + third
            + '", "explanation": "rule"}')


def flat_rule(prompt: str) -> str:
    h = _h(prompt)
    if h[0] == "0":
        return FAILED
    name = _name(h)
    f = name.lower()
    a, b = int(h[3], 16) % 5, int(h[4], 16) % 4
    return ('[{"tag": "' + f"{name} > {f} s{a} > {f} s{a} t{b}" + '", "explanation": "rule"}, '
            '{"tag": "' + name + ' > misc", "explanation": "rule"}]')


def edit_rule(prompt: str) -> str:
    h = _h(prompt)
    if h[0] == "0":
        return FAILED
    return "[edited " + h[:12] + "]"

"""Small helpers for printing and reading reports."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence


def strip_ends(text: str) -> str:
    """Without its first and last character, as of a bracketed list."""
    return text[1:-1]


def is_int(text: str) -> bool:
    return re.fullmatch(r"[+-]?\d+", text) is not None


def int_prefix(text: str) -> int | None:
    """The number that a text begins with."""
    m = re.match(r"\d+", text)
    return int(m[0]) if m else None


def is_blank(text: str) -> bool:
    return not text.strip()


def pad(text: str, width: int) -> str:
    return text.ljust(width)


def has_suffix(text: str, suffix: str) -> bool:
    return text.endswith(suffix)


def common_prefix(a: str, b: str) -> str:
    return os.path.commonprefix([a, b])


def difference(a: str, b: str) -> str:
    """The common beginning, what differs as {a;b}, the common end."""
    head = common_prefix(a, b)
    x, y = a[len(head) :], b[len(head) :]
    tail = common_prefix(x[::-1], y[::-1])[::-1]
    x, y = x[: len(x) - len(tail)], y[: len(y) - len(tail)]
    return head + (disjunction([x, y]) if x or y else "") + tail


def disjunction(parts: Sequence[str]) -> str:
    return "{" + ";".join(parts) + "}"


def column_layout(values: Sequence[object], width: int = 12) -> str:
    """One line of columns of equal width."""
    return "".join(pad(str(v), width) for v in values).rstrip()

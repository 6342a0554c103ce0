"""LIKE patterns."""

from __future__ import annotations

import re


def like_pattern(pattern: str | None) -> str | None:
    r"""A LIKE pattern Spark accepts.

    A backslash before an ordinary character stands for that character; Spark
    takes it only before ``%``, ``_`` and itself.
    """
    if pattern is None:
        return None
    return re.sub(r"\\(.)", lambda pair: pair[0] if pair[1] in "%_\\" else pair[1], pattern)

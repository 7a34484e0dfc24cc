"""Words as problems 3 and 9 define them: the lower-cased runs of letters and digits."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, in order; none for null."""
    return WORD.findall(text.lower()) if text else []

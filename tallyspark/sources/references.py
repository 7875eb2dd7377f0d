"""Character references of web pages."""

from __future__ import annotations

import re
from html import unescape

_LONG = re.compile(r"&#([0-9]{8,});?")


def _number(m: re.Match) -> str:
    digits = m[1].lstrip("0")
    return f"&#{digits or 0};" if len(digits) <= 7 else "�"


def decoded(text: str) -> str:
    """The text with its character references decoded. A decimal reference beyond all characters
    is U+FFFD however long it is (Python reads no number of more than 4,300 digits)."""
    return unescape(_LONG.sub(_number, text) if "&#" in text else text)

"""Texts cut where no tokenizer with white-space pre-tokens looks across, so that ids of a chunk don't depend on what stands around it."""

from __future__ import annotations

import re

#: Before a single blank between two characters that aren't white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Chunks of more characters aren't worth a place in a cache.
LONG = 64
#: Chunks that a worker's cache holds.
CACHE = 300_000


def chunks(text: str) -> list[str]:
    """The chunks of a text; joined they are the text. An empty text has none."""
    return CUT.split(text) if text else []

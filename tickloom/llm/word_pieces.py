"""Words of whole texts as bytes, in pieces, with only A-Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 20


class Words:
    """Splits texts into the matches of a class of bytes.

    ``skipped`` lists the ASCII characters between words, as a character class body; all
    other bytes, those above 127 included, belong to words.
    """

    def __init__(self, skipped: bytes) -> None:
        self.word = re.compile(b"[^" + skipped + b"]+")
        self.gap = re.compile(b"[" + skipped + b"]")

    def pieces(self, text: str | None) -> Iterator[list[bytes]]:
        """The words in order, a list for about every ``PIECE`` bytes; no word is cut."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) <= PIECE:
            yield self.word.findall(raw.translate(LOWER))
            return
        at = 0
        while at < len(raw):
            found = self.gap.search(raw, at + PIECE)
            end = found.start() if found else len(raw)
            yield self.word.findall(raw[at:end].translate(LOWER))
            at = end

"""Cutting a text where every byte-level BPE of the blank-prefixed kind cuts it too.

A blank between two characters that are not white space always begins a new token: no pattern
alternative of such tokenizers crosses it, and none looks beyond it. So the pieces between such
blanks can be encoded alone, each distinct one once. A piece but the first starts with a blank.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Mixed(Exception):
    """White space next to a blank: the text needs the exact cut."""


class PieceTable(dict):
    """Values by piece; ``make`` gives the value of a piece when it is first seen.

    Keys lack the blank that all pieces but the first start with, so that the plain split at
    blanks can be looked up as it is. Pieces with white space at an end never become keys.
    """

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self._make = make
        self._first: dict[str, object] = {}

    def __missing__(self, part: str):
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Mixed
        value = self[part] = self._make(" " + part)
        return value

    def whole(self, piece: str):
        """The value of a piece that keeps all its characters."""
        if piece not in self._first:
            self._first[piece] = self._make(piece)
        return self._first[piece]

    def size(self) -> int:
        return len(self) + len(self._first)

    def clear(self) -> None:
        super().clear()
        self._first.clear()

    def values_of(self, text: str) -> list:
        """The values of the pieces of a text, in order."""
        if not text:
            return []
        head, *parts = text.split(" ")
        try:
            if head and head[-1].isspace():
                raise _Mixed
            values = list(map(self.__getitem__, parts))
        except _Mixed:
            # Blanks that stand next to white space stay inside their piece.
            head, *parts = _CUT.split(text)
            values = [self.whole(" " + part) for part in parts]
        return [self.whole(head), *values] if head else values

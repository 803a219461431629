"""Cutting a text where the split of byte-level BPE always cuts, so that the pieces can be looked up."""

from __future__ import annotations

import re

#: One-byte signs that are a pre-token of their own between a letter and the end of a piece.
SIGNS = frozenset(".,;:!?")
RUN = re.compile(r"\s\s")


def pieces(text: str) -> list[str]:
    """The text in pieces that tokenise on their own; empty ones may be among them.

    A pre-token ends before white space. Of a run of white space the last
    character goes to what follows if it is a space, and is a pre-token of its
    own otherwise. So where no two such characters stand together, cuts before
    spaces and on both sides of line feeds are safe; elsewhere, cuts before
    spaces that stand before something other than white space.
    """
    if "\0" not in text and not RUN.search(text):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    out: list[str] = []
    for i, p in enumerate(text.split(" ")):
        if i and (not p or p[0].isspace()):
            out[-1] += f" {p}"
        else:
            out.append(f" {p}" if i else p)
    return out


def signed(piece: str) -> bool:
    """Whether the piece is a shorter one and a sign after its last letter."""
    return piece[-1:] in SIGNS and piece[-2:-1].isalpha()

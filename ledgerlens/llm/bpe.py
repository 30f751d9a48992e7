"""Merging single pre-tokens with the models of the tokenizers library.

Normalising and pre-tokenizing take the library far longer than merging. For
texts of printable ASCII and the letters of Latin-1 both are known: those
characters are composed already and are each two bytes at most. So pre-tokens of
such characters go to the model alone, in its byte alphabet; any other text goes
to the library whole.
"""

from __future__ import annotations

import functools
import re

#: Characters for which cutting here and cutting in the library agree.
SAFE = re.compile("[\t\n -~À-ÖØ-öø-ÿ]*")


@functools.cache
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@functools.cache
def _table() -> dict[int, str]:
    alphabet = byte_alphabet()
    return {k: "".join(alphabet[b] for b in chr(k).encode()) for k in range(256) if SAFE.fullmatch(chr(k))}


def in_bytes(token: str) -> str:
    return token.translate(_table())

"""Token counts under a byte-level BPE vocabulary read from a file."""

from __future__ import annotations

import base64
import re
from functools import cache

import tiktoken

#: Vocabulary file; every executor has to find it under this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space and the word after it. No piece of PIECES goes on from a word into white space, so the counts of these parts add up.
_PART = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_HELD = 200_000
_WHITE = re.compile(r"[^\S\x1c-\x1f]*")
#: The vocabulary's pattern looks back over white space step by step and fails on very long runs; such are a piece by themselves, but for the character before a word.
_LONG_WHITE = 256


@cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """How many tokens a text has; counts of words are kept for a while, as words come again."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.encode, self.piece = encoding(path).encode_ordinary, encoding(path)._encode_single_piece

    def __missing__(self, part: str) -> int:
        white = _WHITE.match(part).end() if len(part) > _LONG_WHITE else 0
        if white > _LONG_WHITE:
            white -= white < len(part)
            return len(self.piece(part[:white])) + len(self.encode(part[white:]))
        n = len(self.encode(part))
        if len(part) <= 32:
            if len(self) >= _HELD:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _PART.findall(text)))

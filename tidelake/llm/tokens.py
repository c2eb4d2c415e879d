"""Byte-level BPE ids of texts: those of the tokenizers library with add_special_tokens=False.

The same vocabulary is run by tiktoken, which gives the same ids in about a sixth of the time (tests/llm compares
them). A text that holds the string of a special token goes through the tokenizers library itself, and so does one
with a run of blanks so long that tiktoken's way of cutting texts would overflow its stack.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: Fixed value of the vocabulary: how a text is cut before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks in a row from which on the tokenizers library takes over.
_BLANKS = re.compile(r"(?<!\s)\s{20000}")


class Encoder:
    """path is a vocabulary file of the tokenizers library, ranks the same vocabulary for tiktoken."""

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or (len(text) >= 20_000 and _BLANKS.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks: str) -> Encoder:
    """One Encoder for each worker process."""
    return Encoder(path, ranks)

"""Ids of a public byte-level vocabulary, from the installed library, with equal words encoded once."""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

#: Words kept in memory by one Python worker; beyond it the table starts anew.
KEPT = 400_000
#: White space before a space: there the library's own split of the text crosses spaces.
BROKEN = re.compile(r"\s ")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePieces:
    """Encodes texts by a ``tokenizers`` file as the library does, without adding special tokens.

    The vocabulary splits texts before every space that follows a non-space, so the ids of a text are those of
    its space-led words, one after the other. A word is encoded once and then looked up. Texts that hold the string of
    one of the file's added tokens, which the library finds before it splits, go to the library as a whole.
    """

    def __init__(self, path: str):
        self.path = path
        self.words: dict[str, bytes] = {}
        ranks = Path(path).with_suffix(".tiktoken")
        self.whole = by_ranks(str(ranks)) if ranks.exists() else by_file(path)
        self.added = [t["content"] for t in json.loads(Path(path).read_text("utf-8")).get("added_tokens", [])]
        self.library = None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self.added):
            self.library = self.library or by_file(self.path)
            return np.asarray(self.library(text), "<u4").tobytes()
        if BROKEN.search(text) or text[:1] == " ":
            return np.asarray(self.whole(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        words = self.words
        if len(words) > KEPT:
            words.clear()
        missing = set(rest).difference(words)
        for w in missing:
            words[w] = np.asarray(self.whole(f" {w}"), "<u4").tobytes()
        return np.asarray(self.whole(first), "<u4").tobytes() + b"".join([words[w] for w in rest])


def by_file(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def by_ranks(path: str):
    """The same vocabulary as ranks; the same ids at a quarter of the time (tests hold one against the other)."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

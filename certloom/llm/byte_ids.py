"""Token ids of a byte-level BPE tokenizer file, fast enough for whole corpora.

A token of this kind never reaches over a single space that stands before something else than a space, so
a text without two spaces in a row is the pieces between its spaces, and pieces repeat. Their ids are kept
in a bounded table per task. Texts with runs of spaces go to the tokenizer as they are, and so do texts
that hold an added token's string.
"""

from __future__ import annotations

import base64
import json
from struct import pack

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

NAME = "byte_bpe_50k.json"
CACHE = 300_000  # pieces kept per Python worker, some 60 MB


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the `tokenizers` library without added specials."""

    def __init__(self, name: str = NAME):
        path = public_tokenizers.path(name)
        with open(path) as file:
            self.added = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:  # the same vocabulary as ranks
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.whole = Tokenizer.from_file(path)
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.pieces
        unknown = set(rest).difference(known)
        if unknown:
            if len(known) > CACHE:
                known.clear()
                unknown = set(rest)
            encode = self.plain.encode_ordinary
            for piece in unknown:
                ids = encode(" " + piece)
                known[piece] = pack(f"<{len(ids)}I", *ids)
        return np.array(self.plain.encode_ordinary(first), "<u4").tobytes() + b"".join(map(known.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = NAME) -> Encoder:
    """One encoder per Python worker and file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]

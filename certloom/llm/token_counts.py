"""Token counts of a word BPE tokenizer, by rank-synchronous merging of ragged arrays.

Words repeat, so each task counts a word once and keeps a bounded table. The words a batch does not know yet
are merged together: one flat array of symbols with the word each belongs to. In every round each word applies
its lowest-ranked pair, at all places where it stands, until no word has a pair left.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.runtime import slices

NAME, LIMIT = "word_bpe_49k.json", 2048
CACHE = 400_000  # words kept per Python worker, some 50 MB
# White space as the tokenizer file means it; Python's own also has four separators.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}


class Counter:
    """Counts the tokens of texts as the `tokenizers` library does for the file, without adding special tokens."""

    def __init__(self, name: str = NAME):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, int] = {}

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        left = sizes.copy()
        none = np.int64(len(self.keys))
        while len(symbols) > 1:
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            rank = np.append(rank, none)
            lowest = np.minimum.reduceat(rank, starts)
            active = lowest < none
            if not active.any():
                break
            per_symbol = np.repeat(np.where(active, lowest, -1), np.diff(np.append(starts, len(symbols))))
            hit = rank == per_symbol
            # Of pairs that overlap (equal symbols in a row), every second one is taken, from the left.
            run = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
            begun = np.zeros(len(hit), np.int64)
            begun[run] = run
            hit &= (np.arange(len(hit)) - np.maximum.accumulate(begun)) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            kept = per_symbol >= 0  # words without a pair are done
            kept[where + 1] = False
            left -= np.bincount(word[where], minlength=len(left))
            symbols, word = symbols[kept], word[kept]
        return left

    def _learn(self, words: list[str]) -> None:
        """Adds the counts of unknown words to the table."""
        parts, owner = [], []
        for k, w in enumerate(words):
            # Lower-casing goes letter by letter: a final sigma is no special case.
            w = unicodedata.normalize("NFC", w).replace("Σ", "σ").lower()
            for part in self.split.findall(w):
                parts.append(part.encode("utf-8", "surrogatepass"))
                owner.append(k)
        counts = np.bincount(owner, weights=self.surviving(parts), minlength=len(words)) if parts else np.zeros(len(words))
        self.known.update(zip(words, counts.astype(int).tolist()))

    def _words(self, text: str) -> list[str]:
        return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def count(self, texts: list[str]) -> list[int]:
        added = [len(self.special.findall(t)) if "<|" in t else 0 for t in texts]
        words = [self._words(self.special.sub(" ", t) if n else t) for t, n in zip(texts, added)]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        unknown = set().union(*words).difference(known)
        if unknown:
            self._learn(sorted(unknown))
        return [n + sum(map(known.__getitem__, w)) for n, w in zip(added, words)]


_COUNTERS: dict[str, Counter] = {}


def counter(name: str = NAME) -> Counter:
    """One counter per Python worker and file."""
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(name)
    return _COUNTERS[name]


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, tokenizer: str = NAME) -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit. Null texts are empty: 0 and 0.

    Whole texts count; repeated rows count each. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            sizes, tokens = [], []
            for _, texts in slices(batch, "t"):
                sizes += [len(t.encode()) for t in texts]
                tokens += count(texts)
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    kinds = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *[T.StructField(n, k) for n, k in kinds.items()]])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)

"""Exact token counts at every prefix of a text, by prefix dynamic programming over a byte-level BPE vocabulary.

For each end position of a pre-token exactly one token can be the last token of that prefix's encoding: the one that
forms a stable pair with the last token of what lies before it. The table therefore needs one step a byte, and holds
the encoding's length for *every* prefix, so that truncation and budget questions are lookups, not encodings.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import doc_and_text, map_batches, texts_of
from gridloom.llm.encoding import byte_letters

#: The pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose counts a Python worker remembers before it starts afresh.
MEMO_WORDS = 700_000


class PrefixCounter:
    """Counts for one vocabulary file of the tokenizers library (byte-level BPE with merges in rank order)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.longest = max(map(len, self.ids))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = (self.ids[as_bytes(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = self.ids[as_bytes("".join(merge) if isinstance(merge, list) else merge.replace(" ", "", 1))]
            self.parts[whole] = (left, right)
            self.merged[left, right] = whole
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.pattern = regex.compile(PRE_TOKENS)
        self.stable: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int | None] = {}

    def pair_is_stable(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens: no merge crosses the border before both exist.

        The merges on either side are undone, latest first; a pair found at the border that would have merged
        earlier than the side it belongs to was finished makes the two tokens unstable.
        """
        key = left << 20 | right
        known = self.stable.get(key)
        if known is None:
            known = self.stable[key] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        limit = 1 << 30
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            if left > right and left in self.parts:
                limit, left = left, self.parts[left][1]
            elif right in self.parts:
                limit, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                limit, left = left, self.parts[left][1]
            else:
                return True

    def table(self, piece: bytes) -> list[int]:
        """Token counts of piece[:1], piece[:2], ... for one pre-token."""
        whole = self.ids.get(piece)
        size = len(piece)
        if size == 1:
            return [1]
        last, count = [-1] * (size + 1), [0] * (size + 1)
        ids, stable, longest = self.ids, self.stable, self.longest
        for end in range(1, size + 1):
            if whole is not None and end == size:
                count[end] = 1
                break
            for start in range(max(0, end - longest), end):
                token = ids.get(piece[start:end])
                if token is None:
                    continue
                before = last[start]
                if before >= 0:
                    fits = stable.get(before << 20 | token)
                    if fits is None:
                        fits = self.pair_is_stable(before, token)
                    if not fits:
                        continue
                elif start:
                    continue
                last[end], count[end] = token, count[start] + 1
                break
        return count[1:]

    def _sections(self, text: str) -> list[str]:
        """Ordinary text and special strings by turns, ordinary text first."""
        return self.special.split(text) if self.special else [text]

    def _count_exactly(self, text: str) -> int:
        total, pieces = 0, self.pieces
        for i, section in enumerate(self._sections(text)):
            if i % 2:
                total += 1
                continue
            for piece in self.pattern.findall(section):
                n = pieces.get(piece)
                if n is None:
                    n = self.table(piece.encode())[-1]
                    if len(piece) < 40:
                        pieces[piece] = n
                total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of the whole text. Words between single spaces are looked up, as no pre-token spans such a space."""
        if not text:
            return 0
        words = text.split(" ")
        known = self.words
        if len(known) > MEMO_WORDS:
            known.clear()
            self.pieces.clear()
            self.stable.clear()
        total = 0
        try:
            total = sum(map(known.__getitem__, words[1:]))
        except (KeyError, TypeError):
            for word in words[1:]:
                n = known.get(word, -1)
                if n == -1:
                    # A word that is empty or has white space at an end can join white space outside it.
                    n = known[word] = None if not word or word[0].isspace() or word[-1].isspace() else self._count_exactly(" " + word)
                if n is None:
                    return self._count_exactly(text)
                total += n
        first = words[0]
        if len(words) > 1 and (not first or first[-1].isspace()):
            return self._count_exactly(text)
        return total + self._count_exactly(first)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ... (code points), each as if that prefix had been encoded alone."""
        out = np.zeros(len(text), np.int64)
        at = done = earlier = 0
        sections = self._sections(text)
        for i, section in enumerate(sections):
            if i % 2:
                # Cut inside, a special string is ordinary text and joins the section before it.
                for k in range(1, len(section)):
                    out[at + k - 1] = earlier + self._count_exactly(sections[i - 1] + section[:k])
                done += 1
                out[at + len(section) - 1] = done
                at += len(section)
                continue
            earlier = done
            for match in self.pattern.finditer(section):
                piece, start = match.group(), at + match.start()
                if piece[0] == "'" and len(piece) > 2:
                    counts = [self._count_exactly(piece[:k]) for k in range(1, len(piece) + 1)]
                else:
                    table = self.table(piece.encode())
                    ends = np.cumsum([len(c.encode()) for c in piece])
                    counts = [table[e - 1] for e in ends]
                out[start : start + len(piece)] = done + np.asarray(counts)
                done += counts[-1]
            self._mend_spaces(section, at, out)
            at += len(section)
        return out

    def _mend_spaces(self, section: str, at: int, out: np.ndarray) -> None:
        """A prefix that ends inside a run of white space has that run as one pre-token, though the whole text splits it."""
        for run in re.finditer(r"\s{2,}", section):
            before = int(out[at + run.start() - 1]) if at + run.start() else 0
            for k in range(run.start() + 1, run.end() + 1):
                out[at + k - 1] = before + self._count_exactly(section[run.start() : k])

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix whose own encoding has at most `budget` tokens, with no further encoding."""
        counts = self.prefix_counts(text)
        fits = np.nonzero(counts <= budget)[0]
        return text[: int(fits[-1]) + 1] if len(fits) else ""

    def first_over(self, text: str, budget: int) -> int:
        """Length of the shortest prefix with more than `budget` tokens; the text's length plus one if there is none."""
        running = np.maximum.accumulate(self.prefix_counts(text)).tolist()
        return bisect_right(running, budget) + 1


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter a worker process and vocabulary."""
    return PrefixCounter(path)


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; a null or empty text has 0 bytes and 0 tokens.

    One row comes out for each row in, also for repeated rows and null ids; there is no shuffle. Extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        counts = [counter(vocabulary).count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_and_text(documents), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, prefix_tokens: the token count of every prefix, by code point (element i is the prefix of i+1)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [counter(vocabulary).prefix_counts(t).astype(np.int32) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_and_text(documents), run, f"doc_id {kind}, prefix_tokens array<int>")


def truncate_to_budget(documents: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """doc_id, text: each text cut to its longest prefix of at most `budget` tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [counter(vocabulary).truncate(t, budget) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["doc_id", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_and_text(documents), run, f"doc_id {kind}, text string")

"""Token ids of whole texts by the tokenizers library, a batch of texts at a time.

Neither vocabulary joins two words over a single space between non-space characters, so a text's ids are those of its
words (each with the space before it). Arrow splits a batch into words and finds the distinct ones; the library encodes
each of these once, and numpy puts the ids back in place. A text in which white space meets white space is encoded
whole. Results equal the library's on the whole text.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of these after a word is a pre-token of its own in both vocabularies: ASCII punctuation but the apostrophe, which begins contractions.
MARKS = "".join(c for c in string.punctuation if c != "'")
#: Latin letters that are one pre-token together, whatever Unicode version a library has, and one letter each in lower case.
LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"
#: Words that go to the library in one string.
TOGETHER = 64
ID = np.dtype("<u4")
SPACE, LINE_END, NOTHING = (pa.scalar(x, pa.large_string()) for x in (" ", "\n", ""))


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs table[starts[i] : starts[i] + sizes[i]] for i in which, one after another; and where each ends."""
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.arange(total) + np.repeat(starts[which] - (ends - lengths), lengths)], ends


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        suffix = spec["model"].get("end_of_word_suffix")
        # Vocabularies without an end-of-word mark write the space before a word as part of it, and keep line ends.
        self.spaced = not suffix
        self.letters = {b: letter for b, letter in enumerate(byte_letters()) if b >= 32}
        space = self.letters.pop(32)
        #: The same model for words that are pre-tokens as they stand, with a blank between them.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.library.get_vocab()
        #: Whether an id begins a word (the space is its first letter) or ends one.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.startswith(space) if self.spaced else token.endswith(suffix))]] = True
        self.line = self._ids(["\n"])[0]
        self.space = space if self.spaced else ""

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, ID).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _written(self, text: str) -> str:
        """Letters as the vocabulary writes them; white space stays."""
        if self.lower:
            text = text.lower()
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)

    def _plain(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of letters alone, each after a space, and how many each has."""
        n = len(stems)
        if not n:
            return np.zeros(0, ID), np.zeros(0, np.int64)
        edges = np.append(np.arange(0, n, TOGETHER), n)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), stems), SPACE)
        text = self._written(pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(joined)]), joined), LINE_END)[0].as_py())
        text = self.space + text.replace(" ", f" {self.space}").replace("\n", f"\n{self.space}")
        ids: list[int] = []
        for made in self.model.encode_batch_fast(text.split("\n"), add_special_tokens=False):
            ids += made.ids
        found = np.asarray(ids, ID)
        at = np.nonzero(self.edge[found])[0]
        return found, np.diff(np.append(at, len(found))) if self.spaced else np.diff(at, prepend=-1)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, how many each has, and which words need their texts encoded whole."""
        opens = pc.starts_with(words, "\n")
        body = pc.if_else(opens, pc.utf8_slice_codeunits(words, 1), words)
        stem = pc.utf8_rtrim(body, MARKS)
        plain = pc.match_substring_regex(stem, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        opens = opens.to_numpy(zero_copy_only=False) & self.spaced
        after, first, other = np.nonzero(plain & ~opens)[0], np.nonzero(plain & opens)[0], np.nonzero(~plain)[0]
        spaced, openers = (stem.take(pa.array(at)).dictionary_encode() for at in (after, first))
        marked = np.nonzero(plain & (pc.binary_length(body).to_numpy() > pc.binary_length(stem).to_numpy()))[0]
        marks = pc.replace_substring_regex(body.take(pa.array(marked)), f"^{LETTERS}", "").dictionary_encode()
        rest = words.take(pa.array(other)).to_pylist()
        # A word with white space at an end, or none at all, can join white space outside it; where white space is dropped, it can't.
        inner = [w[1:] if w[:1] == "\n" else w for w in rest]
        firm = [bool(w) and (not self.spaced or not (w[0].isspace() or w[-1].isspace())) for w in inner]
        made = iter(self._ids([w if w[0] == "\n" else f" {w}" for w, ok in zip(rest, firm, strict=True) if ok]))
        begin = [np.asarray([t.id for t in self.library.model.tokenize(self._written(w))], ID).tobytes() for w in openers.dictionary.to_pylist()]
        rows = [*begin, *self._ids(marks.dictionary.to_pylist()), self.line, *[next(made) if ok else b"" for ok in firm]]
        # One table of runs: words after a space, words after a line's end, marks after words, a line's end, all other words.
        ids, counts = self._plain(spaced.dictionary)
        table = np.concatenate([ids, np.frombuffer(b"".join(rows), ID)])
        sizes = np.concatenate([counts, np.fromiter(map(len, rows), np.int64, len(rows)) // 4])
        places = np.cumsum([len(counts), len(begin), len(marks.dictionary), 1])
        # Each word is up to three runs: a line's end, the word, the marks after it.
        runs = np.full((len(words), 3), -1, np.int64)
        runs[first, 0] = places[2]
        runs[after, 1] = spaced.indices.to_numpy()
        runs[first, 1] = places[0] + openers.indices.to_numpy()
        runs[marked, 2] = places[1] + marks.indices.to_numpy()
        runs[other, 1] = places[3] + np.arange(len(other))
        present = runs >= 0
        ids, _ = gather(table, np.cumsum(sizes) - sizes, sizes, runs[present])
        needs = np.zeros(len(words), bool)
        needs[other] = self.spaced & ~np.array(firm, bool)
        return ids, np.where(present, sizes[runs], 0).sum(axis=1), needs

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids end, and the ids of all texts, one after another. A null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, ID)
        # Where line ends count, a word after one begins with it; a text's first word too, whose own ids are left out again.
        split = pc.split_pattern(pc.binary_join_element_wise(LINE_END, pc.replace_substring(texts, "\n", " \n"), NOTHING) if self.spaced else pc.replace_substring(texts, "\n", " "), " ")
        stops = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy().astype(np.int64)
        table, sizes, needs = self._words(words.dictionary)
        begins = np.concatenate([[0], stops[:-1]])
        whole = np.nonzero(np.logical_or.reduceat(needs[which], begins) & (pc.utf8_length(texts).to_numpy() > 0))[0] if needs.any() else np.zeros(0, np.int64)
        if len(whole):
            # A text that is encoded whole has one run: it is kept for the first of its words, and the others go.
            rows = self._ids(texts.take(pa.array(whole)).to_pylist())
            extra = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            counts = stops - begins
            keep = np.ones(len(which), bool)
            keep[np.repeat(np.isin(np.arange(n), whole), counts)] = False
            keep[begins[whole]] = True
            which[begins[whole]] = len(sizes) + np.arange(len(whole))
            counts[whole] = 1
            which, stops = which[keep], np.cumsum(counts)
            table, sizes = np.concatenate([table, np.frombuffer(b"".join(rows), ID)]), np.concatenate([sizes, extra])
        ids, ends = gather(table, np.cumsum(sizes) - sizes, sizes, which)
        ends = ends[stops - 1]
        if self.spaced:
            begins = np.concatenate([[0], ends[:-1]])
            lead = len(self.line) // 4
            own = ends > begins
            own[whole] = False
            left_out = np.zeros(len(ids), bool)
            for k in range(lead):
                left_out[begins[own] + k] = True
            ids = ids[~left_out]
            ends = ends - np.cumsum(np.where(own, lead, 0))
        return ends, ids

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As arrays(), with end_id after each text."""
        ends, ids = self.arrays(texts)
        ends = ends + np.arange(1, len(ends) + 1)
        out = np.full(len(ids) + len(ends), end_id, ID)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = ids
        return ends, out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ends, ids = self.arrays(pa.array(texts, pa.string()))
        edges = [0, *ends.tolist()]
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)

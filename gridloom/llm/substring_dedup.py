"""Removal of passages that repeat across documents, by content-defined chunking.

A gear rolling hash runs over each text's bytes; a chunk ends where the hash is the least within a window on either side,
so the cuts depend on nearby bytes alone and an insertion moves no cut but its neighbours. Chunks are grouped by digest
over the whole corpus, the document with the least doc_id keeps a chunk, and runs of chunks that an earlier document holds
are removed from the later ones when enough of them follow each other there too, to be a passage rather than phrases. What
repeats inside one document only stays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import doc_and_text, durable, map_batches, texts_of

#: Bytes that the rolling hash spans, bytes on either side among which a cut's hash is the least, and the longest chunk.
SPAN, REACH, LONGEST = 16, 16, 4096
#: Words that must follow each other in one earlier document for a run of repeated chunks to be removed. A passage of over 50 words keeps this many after its border chunks.
LEAST_WORDS = 16
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A random 64-bit number a byte value, by rule: XXH64 of the value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last SPAN bytes: sum of gear values shifted by their distance, by doubling."""
    out, span = gear()[data], 1
    while span < SPAN:
        longer = out.copy()
        longer[span:] += out[:-span] << np.uint64(span)
        out, span = longer, 2 * span
    return out


def _least_before(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of the `reach` values before each position (past the edge: the largest value)."""
    out = np.full(len(values) + reach, np.iinfo(np.uint64).max, np.uint64)
    out[reach:] = values
    span = 1
    while span < reach:
        step = min(span, reach - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out[: len(values)]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks, the last at the text's end; LONGEST bounds chunks.

    Where hashes tie, as in bytes that repeat with a period of up to REACH, the first and the last of a chain of equal least hashes cut,
    so that such a stretch is a chunk of its own (or several, counted from its own start). What stands close before it can move the first
    cut by a period; then two such stretches have different digests.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    # The high bits depend on all of the span; low ones on the last bytes alone.
    values = rolling(data) * np.uint64(0x9E3779B97F4A7C15)
    before, after = _least_before(values, REACH), _least_before(values[::-1], REACH)[::-1]
    least = np.nonzero(((values <= before) & (values <= after))[:-1])[0]
    gaps = np.diff(least, prepend=-REACH - 1, append=len(data) + REACH)
    ends = np.append(least[(gaps[:-1] > REACH) | (gaps[1:] > REACH)] + 1, len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        starts = ends - gaps
        ends = np.concatenate([np.append(np.arange(a + LONGEST, b, LONGEST), b) for a, b in zip(starts, ends, strict=True)])
    return ends


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the chunks, digests (64 bits of XXH3) and words that begin in each."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = cut_points(data)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
    inside = ~SPACES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    total = np.concatenate([[0], np.cumsum(begins)])
    return ends, digests, total[ends] - total[starts] if len(ends) else ends


def chunk_table(documents: DataFrame) -> DataFrame:
    """doc_id, digest, ordinal, origin: one row a chunk; origin is the first chunk of the document with this digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [chunks(t)[1] for t in texts_of(batch)]
        sizes = np.array([len(d) for d in found], np.int64)
        owner = np.repeat(np.arange(len(found)), sizes)
        digests = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
        ordinals = np.arange(len(digests)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Equal digests of a document lie together in a stable sort, the first of them first.
        order = np.lexsort((digests, owner))
        new = np.append(True, (digests[order][1:] != digests[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(order) else np.zeros(0, bool)
        origin = np.empty(len(digests), np.int64)
        origin[order] = ordinals[order][np.nonzero(new)[0]][np.cumsum(new) - 1] if len(order) else 0
        columns = [batch.column(0).take(pa.array(owner)), pa.array(digests), pa.array(ordinals.astype(np.int32)), pa.array(origin.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "ordinal", "origin"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents, run, f"doc_id {kind}, digest long, ordinal int, origin int")


def repeated_chunks(documents: DataFrame) -> DataFrame:
    """doc_id, repeats: the chunks of each document that a document with a lesser doc_id holds too, as (ordinal, kept_doc_id, kept_ordinal)."""
    table = chunk_table(documents)
    # Only least ids and places are shuffled for all chunks; a very common chunk is summed where it is read.
    firsts = table.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.min_by("origin", "doc_id").alias("place"), F.max("doc_id").alias("last"))
    firsts = durable(firsts.filter("kept < last").select("digest", "kept", "place"), "repeated-digests")
    # One row a digest on this side: a common chunk's rows on the other are split by adaptive execution.
    found = table.join(firsts, "digest").filter("doc_id > kept")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("ordinal", F.col("kept").alias("kept_doc_id"), F.col("place").alias("kept_ordinal"))).alias("repeats"))


def removals(text: str, repeats: list[dict] | None) -> list[tuple[int, int, int, list]]:
    """(start, length, words, kept doc_ids) of the byte runs to remove: consecutive repeated chunks, of which LEAST_WORDS words or more
    follow each other in one earlier document as well.

    Ends inside a word are moved inwards to the nearest white space, so that no word is cut.
    """
    if not repeats:
        return []
    kept = {r["ordinal"]: r["kept_doc_id"] for r in repeats}
    place = {r["ordinal"]: (r["kept_doc_id"], r["kept_ordinal"]) for r in repeats}
    raw = text.encode()
    ends, _, words = chunks(text)
    out = []
    for first in sorted(kept):
        if first - 1 in kept:
            continue
        last = first
        while last + 1 in kept:
            last += 1
        start, end = int(ends[first - 1]) if first else 0, int(ends[last])
        n = int(words[first : last + 1].sum())
        together = most = int(words[first])
        for k in range(first + 1, last + 1):
            (doc, before), now = place[k - 1], place[k]
            together = int(words[k]) + (together if now == (doc, before + 1) else 0)
            most = max(most, together)
        if most < LEAST_WORDS:
            continue
        while start and start < end and not SPACES[raw[start]] and not SPACES[raw[start - 1]]:
            start += 1
        while end < len(raw) and end > start and not SPACES[raw[end]] and not SPACES[raw[end - 1]]:
            end -= 1
        if end > start:
            out.append((start, end - start, n, sorted({kept[k] for k in range(first, last + 1)})))
    return out


def without(text: str, spans: list[tuple]) -> str:
    """The text without the byte spans; what is left on either side of one is joined as it is."""
    raw, at, parts = text.encode(), 0, []
    for start, length, *_ in spans:
        parts.append(raw[at:start])
        at = start + length
    return b"".join([*parts, raw[at:]]).decode("utf-8", "replace")


def removed_spans(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, n_words, kept_doc_ids, text: one row a removed passage, in bytes of the document's UTF-8 text.

    kept_doc_ids are the earlier documents (least doc_id) that hold the passage's chunks and keep them. Documents that
    repeat nothing have no row. Null and empty texts and null doc_ids have none either; rows with one doc_id are one
    document's, and never each other's repeats. An empty table gives no rows. Extra columns are ignored.
    """
    documents = doc_and_text(documents)
    joined = documents.join(repeated_chunks(documents), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, (text, repeats) in enumerate(zip(texts_of(batch), batch.column(2).to_pylist(), strict=True)):
            raw = text.encode()
            for start, length, n, kept in removals(text, repeats):
                at.append(i)
                rows.append((start, length, n, kept, raw[start : start + length].decode("utf-8", "replace")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.string()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", "start", "length", "n_words", "kept_doc_ids", "text"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, run, f"doc_id {kind}, start long, length long, n_words long, kept_doc_ids array<{kind}>, text string")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents, all of them and with all columns, repeated passages taken out of text (and n_chars set, if there).

    A document of which nothing is left stays with an empty text. Rows without repeats keep their texts untouched, nulls too.
    """
    repeats = repeated_chunks(doc_and_text(documents)).select(F.col("doc_id").alias("__repeats_doc_id"), F.col("repeats").alias("__repeats"))
    joined = documents.join(repeats, documents["doc_id"] == repeats["__repeats_doc_id"], "left")
    plain = joined.filter("__repeats is null").select(*documents.columns)
    names = documents.columns
    place = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [without(t, removals(t, r)) for t, r in zip(texts_of(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    cut = map_batches(joined.filter("__repeats is not null").select(*documents.columns, "__repeats"), run, documents.schema)
    if "n_chars" in documents.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)).select(*documents.columns)
    return plain.unionByName(cut)

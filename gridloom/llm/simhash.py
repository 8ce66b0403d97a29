"""SimHash near-duplicates by multi-index hashing.

Documents of one fingerprint are one class. A fingerprint's 64 bits are cut into two segments; of two fingerprints at
most three bits apart, one segment differs in at most one bit. Each fingerprint is stored in one table a segment, under
that segment's value, and looks up the Hamming ball of radius one around its own segment: itself and the values with
one of its zero bits set (the other side of such a pair needs no lookup). Matches are verified on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import doc_and_text, drop_path, durable, give_back, map_batches, small_batches, texts_of
from gridloom.llm.components import connected_components

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEGMENT = 32
#: A segment's value and the values with one of its zero bits set, in SQL over the column `key`.
BALL = f"concat(array(key), transform(filter(sequence(0, {SEGMENT - 1}), i -> shiftright(key, i) % 2 = 0), i -> key + shiftleft(1L, i)))"


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """Unsigned XXH64 of each shingle of `words` words (a shorter text: of all its words; none: nothing), with repeats."""
    found = text.encode().translate(LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) < words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each 1 if it is set in over half of the shingle hashes; as a signed integer."""
    return _majority(np.array(shingle_hashes(text, words), np.uint64))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    majority = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes))
    return int.from_bytes(majority.tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (signed long) of every whole text; a null text is empty and has fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t, words) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_and_text(documents), run, f"doc_id {kind}, fp long")


def close_pairs(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: all pairs of different fingerprints (column fp, distinct) at most `distance` bits apart, some of them twice."""
    if not 0 < distance <= 3:
        raise ValueError("two segments with balls of radius one cover distances 1 to 3")
    segments = F.array(F.shiftrightunsigned("fp", SEGMENT), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)))
    stored = distinct.select("fp", F.posexplode(segments).alias("segment", "key"))
    probes = stored.select(F.col("fp").alias("u"), "segment", F.explode(F.expr(BALL)).alias("key"))
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("fp")))
    return probes.join(stored, ["segment", "key"]).filter((apart > 0) & (apart <= distance)).select("u", F.col("fp").alias("v"))


def near_duplicates(documents: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links, itself included).

    One row comes out for each row in. Null and empty texts have fingerprint zero and link like any other; repeated rows
    are one class. A null doc_id has its fingerprint's component, whose id is the least of the others (null: there is none).
    """
    prints = durable(fingerprints(documents, words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(close_pairs(classes.select("fp"), distance))
    labelled = durable(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    components = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(components, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- Near copies by word-shingle similarity ------------------------------------------------------------------------------

#: Ids that are broadcast, eight bytes each.
BROADCAST_IDS = 1_000_000
#: Shingles that a task counts at once, and frequent shingles (in FREQUENT_DOCS documents or more) by which shingles are ordered. Any order
#: gives the same result.
COUNTED, ORDER_SHINGLES, FREQUENT_DOCS = 4_000_000, 1_000_000, 3
#: Members of a shingle's postings that are compared with all others in one task.
POSTINGS_BLOCK = 512
#: Bits of a set's parity sketches, and their columns of 64 bits. All postings have the short one; where all pairs are compared, the long
#: one takes its place.
SKETCH, LONG_SKETCH = 256, 1024
SKETCHES, LONG_SKETCHES = ([f"{x}{i}" for i in range(bits // 64)] for x, bits in (("s", SKETCH), ("w", LONG_SKETCH)))
#: Sum of two sets' sizes from which their sketches say little, as most of the bits differ by chance.
SATURATED = 1200
#: Pairs a posting that are compared at once, without another round of leaders; a round that links fewer than one class in so many is the last of leaders.
PAIRS_A_POSTING, WORTH = 4, 200
#: Edges whose components one task finds, without rounds.
AT_ONCE = 15_000
#: Saturated pairs that are compared at once, without counts in bins.
COMPARED = 1_000
LONGS = pa.list_(pa.int64())


def _set(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _same(text: str) -> int:
    """A hash of the words, lower-cased."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.encode().translate(LOWER).split()))).view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    """Of sets in one order of elements: two of at least that similarity share an element among the first so many of each."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _frequent(documents: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and their counts, from all documents: they come last in the order of shingles.

    A task counts COUNTED shingles at once and sends on what is there twice or more: what is in few documents meets itself in no task, and
    how many they may be grows with the root of the number of tasks only.
    """

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, often = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[often > 1].view(np.int64)), pa.array(often[often > 1])], names=["shingle", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t in texts_of(batch):
                held.append(_set(t, words))
                size += len(held[-1])
                if size >= COUNTED:
                    yield repeated(held)
                    held, size = [], 0
                    give_back()
        if held:
            yield repeated(held)
        held.clear()
        give_back()

    small_batches(documents.sparkSession)
    counts = doc_and_text(documents).mapInArrow(run, "shingle long, often long").groupBy("shingle").agg(F.sum("often").alias("often"))
    top = counts.filter(F.col("often") >= FREQUENT_DOCS).orderBy(F.desc("often"), "shingle").limit(ORDER_SHINGLES).toArrow()
    found, often = top["shingle"].to_numpy().view(np.uint64), top["often"].to_numpy()
    order = np.argsort(found)
    return found[order], often[order]


def _sketch(found: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Whether an odd number of a set's elements falls on each of so many bits: two sets' sketches differ in at most as many bits as
    there are elements in one of the sets alone."""
    odd = np.bincount((found >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) % 2
    return np.packbits(odd.astype(bool)).view(np.int64)


def prefixes(documents: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, same, n (distinct shingles), fp, prefix (the first shingles, rare ones before frequent ones) and sketches of every whole text."""
    frequent, often = _frequent(documents, words)

    def first(found: np.ndarray) -> np.ndarray:
        if not len(found):
            return found.view(np.int64)
        count = np.zeros(len(found), np.int64)
        if len(frequent):
            at = np.searchsorted(frequent, found).clip(max=len(frequent) - 1)
            count = np.where(frequent[at] == found, often[at], 0)
        return found[np.lexsort((found, count))[: prefix_length(len(found), similarity)]].view(np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        sets, prints = [], []
        for t in texts:
            hashes = np.array(shingle_hashes(t, words), np.uint64)
            prints.append(_majority(hashes))
            sets.append(np.unique(hashes))
        sketches = np.array([np.concatenate([_sketch(x), _sketch(x, LONG_SKETCH)]) for x in sets]).reshape(-1, len(SKETCHES + LONG_SKETCHES))
        columns = [batch.column(0), pa.array(map(_same, texts), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(prints, pa.int64()), pa.array(map(first, sets), LONGS), *map(pa.array, sketches.T.copy())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n", "fp", "prefix", *SKETCHES, *LONG_SKETCHES])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_and_text(documents), run, f"doc_id {kind}, same long, n int, fp long, prefix array<long>, " + ", ".join(f"{x} long" for x in SKETCHES + LONG_SKETCHES))


def _drop(*tables: DataFrame) -> None:
    """Deletes durable tables that are read no more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def _bins(found: np.ndarray) -> np.ndarray:
    """How many elements of a set fall into each of 256 bins: two sets share at most the sum of the lesser counts."""
    return np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256)


def _elements(found: np.ndarray) -> np.ndarray:
    return found.view(np.int64)


def _sets(documents: DataFrame, needed: DataFrame, words: int, view: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """same, view (of the shingles) of the needed classes (same, first), from the texts of their first documents."""
    firsts = needed.select(F.col("first").alias("doc_id")).distinct()
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS else firsts

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        return pa.RecordBatch.from_arrays([pa.array(map(_same, texts), pa.int64()), pa.array([view(_set(t, words)) for t in texts], LONGS)], names=["same", "view"])

    made = map_batches(doc_and_text(documents).join(side, "doc_id", "left_semi"), run, "same long, view array<long>")
    return made.join(needed, "same", "left_semi").groupBy("same").agg(F.first("view").alias("view"))


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """u, v, total: candidates by multi-index hashing, from classes (same, n, fp).

    The classes of one fingerprint meet the first of them, and the first ones of fingerprints at most three bits apart each other.
    """
    classes = classes.filter("n > 0")
    firsts = durable(classes.groupBy("fp").agg(F.min(F.struct("same", "n")).alias("l")).select("fp", "l.*"), "fingerprint-firsts")
    one = classes.alias("a").join(firsts.alias("b"), "fp").filter("a.same != b.same").select(F.col("a.same").alias("u"), F.col("b.same").alias("v"), (F.col("a.n") + F.col("b.n")).alias("total"))
    left, right = (firsts.select(F.col("fp").alias(x), F.col("same").alias(f"same_{x}"), F.col("n").alias(f"n_{x}")) for x in "uv")
    near = close_pairs(firsts.select("fp")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(left, "u").join(right, "v")
    return one.union(near.select("same_u", "same_v", F.col("n_u") + F.col("n_v")))


def _may_be_alike(a: str, b: str, similarity: float, before: str = "place", sketches: list[str] = SKETCHES) -> Column:
    """Of postings a and b of one shingle, by sizes, places in the order and sketches: false only if the sets can't be that similar.

    The column `before` has at least the number of earlier shingles that the sets share.
    """
    most = F.least(f"{a}.{before}", f"{b}.{before}") + 1 + F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place")) - 1
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in sketches[1:]), F.bit_count(F.col(f"{a}.{sketches[0]}").bitwiseXOR(F.col(f"{b}.{sketches[0]}"))))
    return (most * (1 + similarity) >= similarity * total - 1e-6) & (apart * (1 + similarity) <= (1 - similarity) * total + 1e-6)


def _leader_pairs(postings: DataFrame, similarity: float, order: int) -> DataFrame:
    """u, v: members of a shingle's postings and its leader, where they are not yet in one component.

    A leader is the first member by a hash that `order` seeds: rows grow with postings, not with pairs.
    """
    columns = ("same", "n", "place", "component", *SKETCHES)
    rank = F.struct(F.xxhash64("same", F.lit(order)).alias("rank"), *columns)
    met = postings.select(F.struct(*columns).alias("a"), F.min(rank).over(Window.partitionBy("key")).alias("b"))
    met = met.filter((F.col("a.component") != F.col("b.component")) & _may_be_alike("a", "b", similarity))
    return met.select(F.col("a.same").alias("u"), F.col("b.same").alias("v"), (F.col("a.n") + F.col("b.n")).alias("total")).distinct()


def _all_pairs(postings: DataFrame, similarity: float, long_sketches: DataFrame | None = None) -> DataFrame:
    """u, v: all pairs of members of a shingle's postings that are not yet in one component.

    Members of different components have all their common prefix shingles in open postings, most of them in runs: shingles that follow each
    other in the open postings of both. Only where a run begins or ends is there a row; the ends' ranks less the beginnings' count the common
    shingles. Long postings are cut into blocks, each of which meets all members; what can't be alike, by ranks and sketches (the long ones, if
    given: same, LONG_SKETCHES), is left out within the join, and then what shares too few shingles of the prefixes.
    """
    own, everyone = Window.partitionBy("same"), Window.partitionBy("key")
    at = F.row_number().over(own.orderBy("place"))
    ranked = postings.withColumns({"before": F.lag("key").over(own.orderBy("place")), "after": F.lead("key").over(own.orderBy("place")), "rank": at - 1, "left": F.count(F.lit(1)).over(own) - at})
    # Within a run of all members nothing begins or ends.
    steady = [(F.count(x).over(everyone) == F.count(F.lit(1)).over(everyone)) & (F.min(x).over(everyone) == F.max(x).over(everyone)) for x in ("before", "after")]
    if long_sketches is not None:
        ranked = ranked.drop(*SKETCHES)
    sized = ranked.withColumn("steady", F.coalesce(steady[0] & steady[1], F.lit(False))).filter(~F.col("steady")).drop("steady")
    if long_sketches is not None:
        sized = sized.join(long_sketches, "same")
    sized = durable(sized.withColumn("blocks", F.ceil(F.col("members") / POSTINGS_BLOCK)), "runs")
    a = sized.withColumn("block", F.pmod(F.xxhash64("same"), "blocks")).alias("a")
    b = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("b")
    begins, ends = (F.coalesce(F.col(f"a.{x}") != F.col(f"b.{x}"), F.lit(True)) for x in ("before", "after"))
    # What two sets share lies in both prefixes, or after the end of the prefix that ends first in the order of shingles.
    rest = lambda *n: F.greatest(*[F.ceil(similarity * F.col(x) - 1e-9) for x in n]) - 1
    enough = lambda shared, total: shared * (1 + similarity) >= similarity * total - 1e-6
    most = F.least("a.rank", "b.rank") + 1 + F.least("a.left", "b.left") + rest("a.n", "b.n")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.component") < F.col("b.component")) & (begins | ends) & enough(most, F.col("a.n") + F.col("b.n"))
    met = a.join(b, on & _may_be_alike("a", "b", similarity, "rank", SKETCHES if long_sketches is None else LONG_SKETCHES))
    run = F.when(ends, F.col("a.rank") + 1).otherwise(0) - F.when(begins, F.col("a.rank")).otherwise(0)
    met = met.select(F.col("a.same").alias("u"), F.col("b.same").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"), run.alias("run"))
    counted = met.groupBy("u", "v", "nu", "nv").agg(F.sum("run").alias("shared"))
    total = F.col("nu") + F.col("nv")
    return counted.filter(enough(F.col("shared") + rest("nu", "nv"), total)).select("u", "v", total.alias("total"))


def _alike(pairs: DataFrame, documents: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v of the pairs (u, v, total) whose shingle sets are at least that similar, exactly. Where sketches are saturated, counts in bins
    first rule out most pairs."""
    summed = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n)
    shared = {_bins: summed(F.zip_with("su", "sv", lambda x, y: F.least(x, y))), _elements: F.size(F.array_intersect("su", "sv"))}
    long = pairs.filter(F.col("total") >= SATURATED)
    for view in (_bins, _elements):
        tested = pairs if view is _elements else long
        if view is _bins and long.limit(COMPARED + 1).count() <= COMPARED:
            continue
        asked = tested.select(F.col("u").alias("same")).union(tested.select("v")).distinct()
        sets = durable(_sets(documents, durable(classes.join(asked, "same", "left_semi"), "asked"), words, view), "sets")
        left = sets.select(F.col("same").alias("u"), F.col("view").alias("su"))
        right = sets.select(F.col("same").alias("v"), F.col("view").alias("sv"))
        close = tested.join(left, "u").join(right, "v").filter(shared[view] * (1 + similarity) >= similarity * F.col("total") - 1e-9).select("u", "v", "total")
        before, pairs = pairs, durable(close if view is _elements else close.unionByName(pairs.filter(F.col("total") < SATURATED)), "links")
        _drop(sets, before)
    return pairs.select("u", "v")


def _with_component(classes: DataFrame, roots: DataFrame) -> DataFrame:
    columns = [x for x in classes.columns if x != "component"]
    return classes.join(roots, classes["same"] == roots["node"], "left").select(*columns, F.coalesce("root", "same").alias("component"))


def _open(postings: DataFrame) -> DataFrame:
    """Postings (with components) of shingles whose members are not all in one component, and how many members each shingle has."""
    everyone = Window.partitionBy("key")
    sized = {"lo": F.min("component").over(everyone), "hi": F.max("component").over(everyone), "members": F.count(F.lit(1)).over(everyone)}
    return postings.withColumns(sized).filter("lo < hi").drop("lo", "hi")


def _shared(found: DataFrame, prints: DataFrame, classes: DataFrame) -> DataFrame:
    """same, place, key: postings of prefix shingles that several classes have. Nothing else of the classes is shuffled with all postings."""
    copies = durable(prints.join(classes, "same").filter("doc_id != first").select("doc_id", "same"), "copies")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    postings = found.select("doc_id", "same", "prefix").join(side, ["doc_id", "same"], "left_anti").select("same", F.posexplode("prefix").alias("place", "key"))
    everyone = Window.partitionBy("key")
    return postings.withColumns({"lo": F.min("same").over(everyone), "hi": F.max("same").over(everyone)}).filter("lo < hi").select("same", "place", "key")


def _few_pairs(postings: DataFrame) -> bool:
    """Whether all pairs of members that are still apart are at most PAIRS_A_POSTING a posting."""
    members = postings.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    square = lambda x: x.cast("double") * x.cast("double")
    keys = members.groupBy("key").agg(F.sum("m").alias("all"), F.sum(square(F.col("m"))).alias("own"))
    n, pairs = keys.agg(F.sum("all"), F.sum((square(F.col("all")) - F.col("own")) / 2)).first()
    return not n or pairs <= PAIRS_A_POSTING * n


def near_copy_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group_id (least doc_id of its group) of every document with a doc_id.

    Texts of equal words are one class. Classes are linked when the sets of their shingles of `words` words have at least that
    Jaccard similarity. SimHash fingerprints of the same shingles, looked up by multi-index hashing, give the first candidates, which
    are held against the sets. Sets of that similarity can have fingerprints more than three bits apart, but share a shingle of their
    prefixes: rounds compare the members of a prefix shingle's postings that are still apart with a leader, then with another, until
    few pairs are left or few links are found, which keeps large groups from making pairs. At the end all members that are still
    apart are compared with each other, so that no pair is left out.
    """
    documents = documents.filter("doc_id is not null")
    found = durable(prefixes(documents, words, similarity), "prefixes")
    prints = durable(found.select("doc_id", "same"), "prints")
    classes = durable(prints.groupBy("same").agg(F.min("doc_id").alias("first")), "classes")
    marks = durable(found.groupBy("same").agg(F.first("n").alias("n"), F.first("fp").alias("fp")), "marks")
    links = _alike(durable(_fingerprint_pairs(marks), "candidates"), documents, classes, words, similarity)
    roots = connected_components(links, AT_ONCE)
    features = durable(_with_component(found.groupBy("same").agg(*[F.first(x).alias(x) for x in ("n", *SKETCHES, *LONG_SKETCHES)]), roots), "features")
    shared = durable(_shared(found, prints, classes), "shared")
    _drop(found)
    postings = durable(_open(shared.join(features.drop(*LONG_SKETCHES), "same")), "postings")
    _drop(shared)
    order, linked, worth = 0, None, classes.count() // WORTH
    while True:
        # One round of leaders comes first in any case, so that larger tables have no joins that small ones lack.
        last = linked is not None and (linked <= worth or _few_pairs(postings))
        pairs = durable(_all_pairs(postings, similarity, features.select("same", *LONG_SKETCHES)) if last else _leader_pairs(postings, similarity, order), "candidates")
        found = _alike(pairs, documents, classes, words, similarity)
        linked = found.count()
        if linked:
            links = links.union(found)
            roots = connected_components(links, AT_ONCE)
        if last:
            _drop(postings, features)
            break
        before, postings = postings, durable(_open(_with_component(postings, roots)), "postings")
        _drop(before)
        order += 1
    labelled = durable(_with_component(classes, roots), "labelled")
    groups = labelled.join(labelled.groupBy("component").agg(F.min("first").alias("group_id")), "component").select("same", "group_id")
    return prints.join(groups, "same").select("doc_id", "group_id")


def keep_first_of_group(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies: of each group the one with the least doc_id stays, with all its columns.

    Rows that share a doc_id are one document, of which one row stays. Rows without a doc_id stay.
    """
    groups = durable(near_copy_groups(documents, words, similarity), "groups")
    dropped = durable(groups.filter("group_id != doc_id").select("doc_id").distinct(), "dropped")
    # Few enough ids go to every task, and the texts stay where they are; more are joined by shuffling.
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    kept = documents.join(side, "doc_id", "left_anti").select(*documents.columns)
    if groups.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))

"""Mixing sources to target weights with a time-varying curriculum.

Sizes are words. A source's target is its weight's share of all sizes, at most `max_repeats` times its own size, what
exceeds that being shared again by weight. Each source's weight follows a schedule over training time t in [0, 1];
the schedule's integral is the source's cumulative demand, and its inverse gives the time at which a document's words
are asked for. Documents are then range-sorted by that position.

Cumulative sizes are prefix sums in two levels (hash bands of a source, then documents within a band), so a source
with any share of the rows is spread over as many tasks as its size needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a hash band, about.
BAND_ROWS = 1000
#: Sources up to which their one row each goes to every task; more are joined by shuffling.
BROADCAST_SOURCES = 20_000
#: Weight of the k-th source by code point (null last) is this list, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Weight at t=1 against that at t=0 of the k-th source, repeating: a source that grows, stays or fades over training.
SLOPES = (2.0, 1.0, 0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(rank: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size, n_docs, rank, target: one row a source.

    Each target is min(max_repeats * size, level * weight) for the one level at which targets add up to all sizes; the
    level is found by a running sum over sources in order of size/weight. Sources are a dimension: one row each is sorted.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", _cycle(F.col("rank"), weights))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    sources = (
        sources.withColumn("cap", F.col("source_size") * float(max_repeats))
        .withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    )
    # Sources before the first one that its own level doesn't cap are held at their caps.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(everything)["level"]
    return sources.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "n_docs", "rank", "target")


def _position(share: Column, slope: Column) -> Column:
    """The time t at which a linear schedule from 1 to `slope` has given `share` of its integral: W(t) = t + (slope-1)t^2/2."""
    bend = slope - 1.0
    whole = 1.0 + bend / 2.0
    root = (F.sqrt(1.0 + 2.0 * bend * share * whole) - 1.0) / F.when(bend == 0.0, F.lit(1.0)).otherwise(bend)
    return F.when(bend == 0.0, share).otherwise(F.abs(root))


def _key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, slopes: tuple[float, ...] = SLOPES, key: bool = False) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken, position; if asked for, `key`, its hash, and start, goal and slope.

    taken counts words with repeats, 0 to max_repeats * size: a source's target is dealt out along the documents in the order
    of a hash of doc_id, source and text, whole rounds first; the last document taken may be taken in part, so a source's taken
    words are its target to within one word. position is the training time of a document's first taken word (null: none).

    A null text has size 0; a null source is a source of its own, the last; repeated rows count each; the order of equal
    rows doesn't matter. Empty tables give no rows. Extra columns are ignored. Reruns agree.
    """
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key().alias("key"))
    # Sizes are needed by the sums and by the dealing; texts are read once for them, and lost executors don't change that.
    sized = durable(sized, "mixing-sizes")
    targets = durable(source_targets(sized, weights, max_repeats), "mixing-targets")
    few = targets.count() <= BROADCAST_SOURCES
    # Band of a document: its key's place in the hash range, in as many bands as its source has of BAND_ROWS documents.
    spread = (F.shiftrightunsigned(F.col("key"), 11).cast("double")) / float(1 << 53)
    width = F.ceil(F.col("n_docs") / BAND_ROWS)
    join = lambda left, right, on: left.join(right, left[on].eqNullSafe(right[on])).drop(right[on])
    banded = join(sized, F.broadcast(targets) if few else targets, "source").withColumn("band", F.floor(spread * width).cast("long"))
    bands = banded.groupBy("rank", "band").agg(F.sum("size").alias("band_size"))
    # Prefix sums over bands in two levels as well: super-bands of 1000 bands.
    bands = bands.withColumn("super", F.floor(F.col("band") / 1000))
    upper = bands.groupBy("rank", "super").agg(F.sum("band_size").alias("super_size"))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("super_start", F.coalesce(F.sum("super_size").over(preceding(Window.partitionBy("rank").orderBy("super"))), F.lit(0))).drop("super_size")
    bands = bands.withColumn("inner", F.coalesce(F.sum("band_size").over(preceding(Window.partitionBy("rank", "super").orderBy("band"))), F.lit(0)))
    bands = bands.join(upper, ["rank", "super"]).select("rank", "band", (F.col("super_start") + F.col("inner")).alias("band_start"))
    placed = banded.join(bands, ["rank", "band"])
    order = Window.partitionBy("rank", "band").orderBy("key", F.asc_nulls_first("doc_id"), "size")
    start = F.col("band_start") + F.coalesce(F.sum("size").over(preceding(order)), F.lit(0))
    goal = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("start", start).withColumn("goal", F.least(goal, F.col("source_size") * max_repeats)).withColumn("rounds", F.least(rounds, F.lit(max_repeats)))
    rest = F.greatest(F.least(F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("start"), F.col("size")), F.lit(0))
    placed = placed.withColumn("taken", (F.col("rounds") * F.col("size") + rest).cast("long"))
    share = F.when(F.col("goal") > 0, F.col("start") / F.col("goal"))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, _position(F.least(share, F.lit(1.0)), _cycle(F.col("rank"), slopes))))
    placed = placed.withColumn("slope", _cycle(F.col("rank"), slopes))
    return placed.select("doc_id", "size", "source", "source_size", "target", "taken", "position", *(["key", "start", "goal", "slope"] if key else []))


def training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """Documents range-sorted by training position; the ones that aren't taken come last."""
    order = [F.asc_nulls_last("position"), F.asc_nulls_last("doc_id")]
    return mixed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)



def copies_of(taken: Column, size: Column) -> Column:
    """Words that each copy of a document has: whole copies, then what is left."""
    n = F.ceil(taken / F.when(size > 0, size)).cast("int")
    return F.when(taken > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.least(size, taken - size * (k - 1))))


def repeat_documents(documents: DataFrame, partitions: int) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken, range-sorted by training position.

    A copy that is taken in part has the text's first words, with the white space before each, and its n_chars. Documents that
    the mix doesn't take are left out, as are texts without words. Each copy has the training time of its own first word.
    """
    mixed = mix(documents, key=True)
    one = [F.max(x).alias(f"__mix_{x}") for x in ("size", "source_size", "goal", "slope")]
    totals = mixed.groupBy(F.col("key").alias("__mix_key"), F.col("doc_id").alias("__mix_doc_id")).agg(F.sum("taken").alias("__mix_taken"), F.min("start").alias("__mix_start"), F.count(F.lit(1)).alias("__mix_rows"), *one)
    totals = durable(totals.filter("__mix_taken > 0"), "mixing-taken")
    keyed = documents.withColumn("__mix_own", _key())
    joined = keyed.join(totals, (F.col("__mix_own") == F.col("__mix_key")) & F.col("doc_id").eqNullSafe(F.col("__mix_doc_id")))
    if not totals.filter("__mix_rows > 1").isEmpty():
        joined = joined.dropDuplicates(["__mix_key", "__mix_doc_id"])
    size = F.col("__mix_size")
    copies = joined.select(*documents.columns, "__mix_size", "__mix_source_size", "__mix_goal", "__mix_slope", "__mix_start", "__mix_rows", F.posexplode(copies_of(F.col("__mix_taken"), size)).alias("__mix_round", "__mix_words"))
    # Equal rows follow each other within a round over the source.
    nth = F.floor(F.col("__mix_round") / F.col("__mix_rows")) * F.col("__mix_source_size") + F.col("__mix_round") % F.col("__mix_rows") * size
    share = (F.col("__mix_start") + nth) / F.col("__mix_goal")
    copies = copies.withColumn("__mix_position", _position(F.least(share, F.lit(1.0)), F.col("__mix_slope")))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("__mix_words") < size, F.array_join(F.slice(pieces, 1, F.col("__mix_words").cast("int")), "")).otherwise(F.col("text"))
    copies = copies.withColumn("text", text)
    if "n_chars" in documents.columns:
        copies = copies.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    order = [F.asc_nulls_last("__mix_position"), F.asc_nulls_last("doc_id")]
    return copies.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select(*documents.columns)

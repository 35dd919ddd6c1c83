"""MinHash near-duplicates with min-max hashing: of each permutation both the minimum and the maximum are kept.

A document's set holds the hashes of its distinct five-word shingles. A permutation of the hashes yields two
nearly independent signature values, so half as many permutations are evaluated; both values go into the
bands. Documents that share a band are candidates, and every link is confirmed on the full sets.

No bucket emits all its pairs. Equal sets are one class from the start. Each bucket first links its members
with its smallest one; where that leaves a bucket in several components, blocks of members are compared, a component's
never with its own, and only links that join components come out. So no link between candidates is lost, whatever a
bucket's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelry.llm.shared import among, components, may_be_among, saved, unused
from panelry.llm.text_arrays import Hasher, buffers, mix, runs, slices, word_spans

WORDS = 5
PERMUTATIONS_PER_BAND = 3
#: Two documents at the least similarity share no band with this probability at most: 24 bands at 0.85, 38 at 0.8.
MISS = 1.2e-5
#: Bands at most, which 0.56 needs; below that similarity more links are missed.
MOST_BANDS = 384
#: Members of a pivot from which on its comparisons are dealt to several tasks, and to how many.
HOT_PIVOT, SHARES = 256, 64
#: Members of one block of a bucket.
BLOCK_ROWS = 128
_RNG = np.random.default_rng(85)
_PERMUTATIONS = MOST_BANDS * PERMUTATIONS_PER_BAND
_TIMES = _RNG.integers(0, 2**64, _PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 2**64, _PERMUTATIONS, dtype=np.uint64)
_FOLD = _RNG.integers(0, 2**64, (64, 2), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 2**64, (MOST_BANDS, 2 * PERMUTATIONS_PER_BAND), dtype=np.uint64) | np.uint64(1)
#: Shingles whose permutations are held at once.
_STEP = 1024
_SIGNATURE = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, of at most 64 words. Fewer words make one shingle; no words make none."""
    data, at = buffers(texts)
    for first, last in slices(at):
        own = at[first : last + 1] - at[first]
        piece = data[at[first] : at[last]]
        starts, ends, counts = word_spans(piece, own)
        word = Hasher(piece, lower=True).between(starts, ends)
        opens = np.concatenate(([0], np.cumsum(counts)))
        rolled = np.zeros(len(word), np.uint64)
        width = len(word) - words + 1
        if width > 0:
            for i in range(words):
                rolled[:width] += word[i : i + width] * _FOLD[i, 0]
            rolled = mix(rolled)
        for d in range(last - first):
            n, o = int(counts[d]), int(opens[d])
            if n >= words:
                yield np.unique(rolled[o : o + n - words + 1])
            elif n:
                salted = word[o : o + n] * _FOLD[:n, 1]
                yield mix(np.array([salted.sum(dtype=np.uint64) + np.uint64(n)]))
            else:
                yield np.empty(0, np.uint64)


def bands_for(percent: int) -> int:
    """Bands that leave a pair of the least similarity without a common one with a probability of ``MISS``."""
    shared = (percent / 100) ** (2 * PERMUTATIONS_PER_BAND)
    return 1 if shared >= 1 else min(MOST_BANDS, math.ceil(math.log(MISS) / math.log1p(-shared))) if shared > 0 else MOST_BANDS


def band_values(shingles: np.ndarray, bands: int) -> np.ndarray:
    """One value per band from the minimum and the maximum of the band's permutations."""
    used = bands * PERMUTATIONS_PER_BAND
    low = np.full(used, 2**64 - 1, np.uint64)
    high = np.zeros(used, np.uint64)
    for first in range(0, len(shingles), _STEP):
        values = _TIMES[:used, None] * shingles[first : first + _STEP]
        values += _PLUS[:used, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    both = np.stack((low, high), axis=1).reshape(bands, -1)
    return mix((both * _BAND[:bands]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def signatures(docs: DataFrame, count: int) -> DataFrame:
    """Set size, a 128-bit print of the set and the band values of each document's whole text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            bands, used = np.zeros((n, count), np.uint64), np.zeros(n, bool)
            for i, s in enumerate(shingle_sets(batch.column(1))):
                if len(s):
                    sizes[i], used[i] = len(s), True
                    prints[i] = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    bands[i] = band_values(s, count)
            ends = np.concatenate(([0], np.cumsum(np.where(used, count, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[used].ravel().view(np.int64)))
            columns = [batch.column(0), pa.array(sizes), pa.array(prints[:, 0].copy().view(np.int64)), pa.array(prints[:, 1].copy().view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print_a", "print_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, _SIGNATURE)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The many pairs of one ``a`` are dealt to ``SHARES`` tasks."""
    hot = may_be_among(saved(pairs.groupBy("a").count().where(F.col("count") > HOT_PIVOT).select("a"), "hot"), "a")
    none = F.lit(0)
    mine = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # The other text of a pair comes first, so that no task gets it only for the pivot's sake.
    members = pairs.join(mine, "b").withColumn("share", F.when(hot(F.col("a")), F.pmod(F.xxhash64("b"), F.lit(SHARES))).otherwise(none).cast("int"))
    every = F.when(hot(F.col("doc_id")), F.sequence(none, F.lit(SHARES - 1))).otherwise(F.array(none))
    pivots = texts.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")
    shares = pivots.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), F.explode(every).alias("share"))
    joined = members.join(shares, ["a", "share"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [similar(a, b, percent) for a, b in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(held, pa.bool_()))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def joining_links(sets: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, no more than it takes to join the groups they join."""
    group = np.unique(groups, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    links = []
    for x in range(len(sets)):
        if (group == group[x]).all():
            continue
        held = np.zeros(terms.max() + 1, np.int64)
        held[terms[starts[x] : starts[x] + sizes[x]]] = 1
        both = np.add.reduceat(held[terms], starts)
        for y in np.flatnonzero((100 * both >= percent * (sizes + sizes[x] - both)) & (group != group[x])):
            if group[y] != group[x]:
                links.append((x, int(y)))
                group[group == group[y]] = group[x]
    return links


def _cells(rest: DataFrame) -> DataFrame:
    """(cell, rep, component): which members of (key, rep, component) meet in which comparison.

    The blocks of a bucket meet in pairs, but never two blocks of one component. So a large component beside a few strays
    is sent once, and once more to each further block of strays.
    """
    # A component of a block's size or more has blocks of its own; the members of smaller ones are mixed.
    sizes = saved(rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    mixed = sizes.where(F.col("n") < BLOCK_ROWS).groupBy("key").agg(F.sum("n").alias("mixed"))
    shares = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    large = F.col("n") >= BLOCK_ROWS
    placed = saved(
        rest.join(sizes, ["key", "component"]).join(mixed, "key", "left")
        .withColumn("of", F.when(large, F.col("component")))
        .withColumn("block", F.pmod(F.xxhash64("rep"), shares(F.when(large, F.col("n")).otherwise(F.col("mixed")))).cast("int"))
        .select("key", "of", "block", "rep", "component"),
        "blocks",
    )
    blocks = placed.select("key", F.struct(F.coalesce(F.col("of"), F.lit(-(2**63))).alias("of"), F.col("block")).alias("at"), F.col("of").isNull().alias("mix")).distinct()
    i, j = blocks.select("key", F.col("at").alias("i"), F.col("mix").alias("i_mix")), blocks.select("key", F.col("at").alias("j"), F.col("mix").alias("j_mix"))
    cells = i.join(j, "key").where("i <= j and (i.of <> j.of or (i_mix and j_mix))").select("key", "i", "j")
    sides = cells.withColumn("at", F.explode(F.array_distinct(F.array("i", "j"))))
    at = F.struct(F.coalesce(F.col("of"), F.lit(-(2**63))).alias("of"), F.col("block"))
    return placed.select("key", at.alias("at"), "rep", "component").join(sides, ["key", "at"]).select(
        F.xxhash64("key", "i", "j").alias("cell"), "rep", "component"
    )


def _rest_of_buckets(members: DataFrame, texts: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, beside those with the bucket's smallest member.

    ``members`` holds (key, rep, pivot), ``group`` the component of those that have one.
    """
    rest = (
        members.where("rep <> pivot").join(group.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    facts = rest.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    ).where("low <> high")
    # Bands often agree on a bucket's members; one bucket of each member list is enough.
    chosen = facts.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    texted = _cells(rest.join(chosen, "key")).join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        sets = list(shingle_sets(table.column("text")))
        links = joining_links(sets, table.column("component").to_numpy(), percent)
        a, b = (reps[[p[k] for p in links]] if links else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return texted.select("cell", "rep", "component", "text").groupBy("cell").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their sets. A null or empty text, or one
    without words, has an empty set and links with nothing. Equal texts are linked. Rows that share a
    doc_id are one document: they share its links, compared by one of their texts. A row with a null
    doc_id links with nothing, has a null component and is kept. Other columns are not read.
    """
    signed = saved(signatures(docs, bands_for(percent)), "signatures")
    classes = saved(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("print_a", "print_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last").drop("last")
    members = saved(banded.join(shared, "key"), "members")
    stars = saved(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = saved(among(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    group = saved(components(_confirmed(stars, texts, percent)), "components")
    more = saved(_rest_of_buckets(members, texts, group, percent), "more-links")
    of = lambda side: group.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component"))
    joining = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")
    )
    upper = components(joining)
    labels = (
        classes.select("print_a", "print_b", "n_shingles", "rep").join(group.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("low", F.coalesce("component", "rep")).drop("component")
        .join(upper.withColumnRenamed("id", "low"), "low", "left")
        .select("print_a", "print_b", "n_shingles", F.coalesce("component", "low").alias("component"))
    )
    return (
        signed.select("doc_id", "n_shingles", "print_a", "print_b").join(labels, ["print_a", "print_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group, with all its columns. Of rows that share a doc_id one stays, as of rows
    that share a text and have no doc_id."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id")
    nameless = F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    key = unused(docs, "_nameless")
    rest = docs.join(gone, "doc_id", "left_anti").withColumn(key, nameless)
    return rest.dropDuplicates(["doc_id", key]).select(*docs.columns)

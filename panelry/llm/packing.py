"""Best-two-fit packing of tokenized documents into sequences of bounded length.

The packing is planned on how many pieces of each length there are, at most one count per token length, so
the plan's size does not grow with the corpus. Spark then gives every piece its number within its length and
reads its sequence and offset off the plan.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelry.llm.shared import numbered, saved

CAPACITY = 2048
END = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Tokenizers loaded by this process, by path.
_LOADED: dict[tuple[str, str], object] = {}


class Encoder:
    """Token ids of a tokenizer file. A rank file of the same vocabulary, if given, encodes several times faster;
    special tokens and what the rank encoder refuses go through the tokenizer file itself."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.special = tuple(t.content for t in self.slow.get_added_tokens_decoder().values() if t.content)
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as problem:  # the rank encoder's panics are no Exceptions
                if isinstance(problem, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def _encoder(tokenizer: str, ranks: str | None, pattern: str | None) -> Encoder:
    if (tokenizer, ranks) not in _LOADED:
        _LOADED[tokenizer, ranks] = Encoder(tokenizer, ranks, pattern)
    return _LOADED[tokenizer, ranks]


#: Slots of a plan that is broadcast, 40 bytes each; a larger one is joined by length.
BROADCAST_SLOTS = 500_000


def token_pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of every document's ids and the end id: one piece, or full pieces after a first that may be shorter.

    A null or empty text is the end id alone. The paths are those of public tokenizer files on every machine.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks, pattern)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END)
                raw, n, start, piece = memoryview(np.array(ids, "<u4").tobytes()), len(ids), 0, 0
                end = n if n <= capacity else n % capacity or capacity
                while start < n:
                    out.append((doc_id, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, _PIECES)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, how many bins) that hold ``counts`` pieces of each length.

    Each pattern is filled greedily, longest first; then its smallest piece gives way to the two open
    lengths that fill the widened gap most tightly, if they fill it better. The pattern is used as often as
    the counts allow before the next is sought.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        bin_, gap = [], capacity
        while True:
            fit = np.flatnonzero(left[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            n = min(gap // length, int(left[length]))
            bin_ += [length] * n
            left[length] -= n
            gap -= n * length
        if len(bin_) > 1 and gap:
            smallest = bin_[-1]
            room = gap + smallest
            lengths = np.flatnonzero(left[: room + 1])
            if len(lengths):
                # For each shorter partner the longest length that still fits beside it.
                mates = np.searchsorted(lengths, room - lengths, side="right") - 1
                some = mates >= 0
                a, b = lengths[some], lengths[mates[some]]
                sums = np.where((a == b) & (left[a] < 2), 0, a + b)
                # A length that is there once can't pair with itself: take the next shorter mate.
                lone = np.flatnonzero((sums == 0) & (mates[some] > 0))
                if len(lone):
                    b[lone] = lengths[mates[some][lone] - 1]
                    sums[lone] = a[lone] + b[lone]
                best = int(np.argmax(sums)) if len(sums) else 0
                if len(sums) and sums[best] > smallest:
                    bin_[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
                    left[smallest] += 1
                    left[a[best]] -= 1
                    left[b[best]] -= 1
        used: dict[int, int] = {}
        for length in bin_:
            used[length] = used.get(length, 0) + 1
        again = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= again * n
        patterns.append((bin_, 1 + again))
    return patterns


def plan_slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence, offset): pieces number first..last of a length go to consecutive sequences."""
    slots, taken, base = [], {}, 0
    for bin_, times in patterns:
        offset = 0
        for length in bin_:
            first = taken.get(length, 0)
            taken[length] = first + times
            slots.append((length, first, first + times - 1, base, offset))
            offset += length
        base += times
    return slots


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """Every piece with the sequence it goes to and its offset there.

    Lengths are gathered as counts (at most ``capacity`` rows). Repeated rows are packed one by one; a null
    doc_id stays null. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    pieces = saved(token_pieces(docs, tokenizer, ranks, pattern, capacity), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_slots(best_two_fit(counts, capacity))
    plan = spark.createDataFrame(slots, "length long, first long, last long, sequence long, offset long")
    ranked = numbered(pieces, ["length"], [F.col("doc_id"), F.col("piece")], sum(counts.values()), "rank")
    # Most pieces of long documents share one length: the plan goes to every task while it is small.
    a, b = ranked.alias("a"), (F.broadcast(plan) if len(slots) <= BROADCAST_SLOTS else plan).alias("b")
    here = (F.col("a.length") == F.col("b.length")) & F.col("a.rank").between(F.col("b.first"), F.col("b.last"))
    return a.join(b, here).select(
        "a.doc_id", "a.piece", "a.start", "a.length", "a.ids_crc32",
        (F.col("b.sequence") + F.col("a.rank") - F.col("b.first")).alias("sequence_id"), "b.offset",
    )

"""Removal of byte strings that an earlier document also has, by a range-partitioned sort of suffixes.

A sort of every suffix would move each byte ``length`` times. Here only the suffixes at anchors are sorted:
an anchor is where the ``lead`` bytes have the smallest hash of all leads in a window of ``length`` bytes.
Equal windows have equal anchors, so two documents that share a window meet at the anchor's key. A region is a run of
windows with one anchor.

1. Each anchor sends its key (the first bytes of its suffix, then a hash of its lead) and a hash of its region.
   Splitters sampled from the keys range-partition them; a bucket is sorted by key, region and document, and
   neighbours are compared. Equal keys never straddle a boundary. A region that a smaller document has too is solved;
   a key with different regions is open.
2. The first document with an open region sends the region's bytes under the same key. All windows
   of a bucket's regions are sorted by content and document, and each is compared with the first that equals it.
3. Each document marks the windows found, and drops the bytes they cover.

A batch sends an equal region once, for its smallest document, so a passage that a third of all documents hold
makes one entry per batch and region.

A key that many documents hold with different bytes around it (a phrase shorter than ``length``) would be one unbounded
group. A sample that grows with the table finds such hot keys. Their regions spread over all buckets by their hash and
are all open; their windows are sent as hashes and spread by content, an equal one once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from panelry.llm.shared import saved
from panelry.llm.text_arrays import SLICE_BYTES, Hasher, buffers, parts, runs, slices

LENGTH, LEAD = 50, 24
#: Text bytes per bucket of the range partition, on average.
BUCKET_BYTES = 8 << 20
#: Text bytes that one pass over a batch holds the regions of.
PART_BYTES = 8 << 20
SAMPLE_DOCS, SAMPLE_KEYS = 512, 32
#: A key with about so many regions is hot; the sample holds about ``HOT_SAMPLED`` regions or more of each such key.
HOT_ROWS, HOT_SAMPLED = 1 << 14, 16
_LAST = 2**63 - 1
_U = np.uint64


class Regions:
    """The regions of a slice of texts, in order: owner, first and last window, key and hash of each.

    A lead's value is its hash with its first two bytes in the lowest places; the key turns that around, so
    keys sort by the leading bytes of the suffix.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, lead: int):
        counts = np.maximum(np.diff(at) - length + 1, 0)
        if not counts.any():
            self.owner = self.first = self.last = np.empty(0, np.int64)
            self.key = self.hash = np.empty(0, np.uint64)
            return
        hasher = Hasher(data)
        leads = hasher.windows(lead) & ~_U(0xFFFF)
        leads |= (data[: len(leads)].astype(np.uint64) << _U(8)) | data[1 : len(leads) + 1]
        span, low, width = length - lead + 1, leads, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: width - span], low[span - width :])
        owner = np.repeat(np.arange(len(counts)), counts)
        windows = at[owner] + runs(counts)
        least = low[windows]
        opens = np.ones(len(windows), bool)
        opens[1:] = (np.diff(windows) != 1) | (least[1:] != least[:-1])
        begin = np.flatnonzero(opens)
        self.owner, self.first = owner[begin], windows[begin]
        self.last = windows[np.append(begin[1:], len(windows)) - 1]
        self.key = (least[begin] << _U(48)) | (least[begin] >> _U(16))
        self.hash = hasher.between(self.first, self.last + length)


class Plan(NamedTuple):
    """Bounds of the buckets in key order, and the sorted hot keys."""

    splitters: np.ndarray
    hot: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.splitters) + 1

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(keys), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)] == keys

    def bucket_of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        by_key = np.searchsorted(self.splitters, keys, side="right")
        return np.where(self.is_hot(keys), hashes % _U(self.buckets), by_key).astype(np.int32)


NO_PLAN = Plan(np.empty(0, np.uint64), np.empty(0, np.uint64))


class Batch:
    """The regions of a batch of documents, numbered within each document and bucket."""

    def __init__(self, texts: pa.Array, plan: Plan, length: int, lead: int):
        self.data, self.at = buffers(texts)
        found = []
        for a, b in slices(self.at):
            r = Regions(self.data[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a], length, lead)
            found.append((*((x + y).astype(np.int32) for x, y in ((r.owner, a), (r.first, self.at[a]), (r.last, self.at[a]))), r.key, r.hash))
        kinds = (np.int32,) * 3 + (np.uint64,) * 2
        self.owner, self.first, self.last, self.key, self.hash = (
            np.concatenate([np.empty(0, t), *x]) for t, x in zip(kinds, zip(*found) if found else [()] * 5)
        )
        del found
        self.bucket = plan.bucket_of(self.key, self.hash)
        cell = self.owner.astype(np.int64) * plan.buckets + self.bucket
        self._order = np.argsort(cell, kind="stable").astype(np.int32)
        self._cells = cell[self._order]
        self._buckets = plan.buckets
        heads = np.flatnonzero(np.append(True, self._cells[1:] != self._cells[:-1])) if len(cell) else np.empty(0, np.int64)
        self.number = np.empty(len(cell), np.int32)
        self.number[self._order] = runs(np.diff(np.append(heads, len(cell))))

    def at_code(self, owner: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The regions that codes name."""
        cell = owner * self._buckets + (code >> 33)
        return self._order[np.searchsorted(self._cells, cell) + ((code >> 1) & 0xFFFFFFFF)]


def codes_of(bucket: np.ndarray | int, number: np.ndarray, is_open: np.ndarray | int) -> np.ndarray:
    return (np.int64(1) * bucket << 33) | (number.astype(np.int64) << 1) | is_open


def plan_of(docs: DataFrame, rows: int, buckets: int, length: int, lead: int) -> Plan:
    """Bounds of nearly equal shares of the keys, and the hot keys, from a sample of documents.

    The sample is as large as it takes to see a hot key ``HOT_SAMPLED`` times: at least 512 documents, one in 1,024
    of a very large table. A key counts as hot from half of what is expected, so to miss one is unlikely.
    """
    if buckets < 2:
        return NO_PLAN
    fraction = min(1.0, max(SAMPLE_DOCS / max(1, rows), HOT_SAMPLED / HOT_ROWS))
    per_doc = SAMPLE_KEYS * min(1.0, SAMPLE_DOCS / max(1.0, rows * fraction))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 0, PART_BYTES)):
            b = Batch(batch.column(0), NO_PLAN, length, lead)
            picked = np.zeros(len(b.key), np.int32)
            picked[:: max(1, int(len(b.key) / max(1.0, per_doc * batch.num_rows)))] = 1
            yield pa.RecordBatch.from_arrays([pa.array(b.key.view(np.int64)), pa.array(picked)], ["key", "picked"])

    sample = docs.select("text").sample(fraction=fraction, seed=7).mapInArrow(keys, "key long, picked int")
    counts = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("picked").alias("picked"))
    least = max(2, int(HOT_ROWS * fraction / 2))
    found = counts.where((F.col("picked") > 0) | (F.col("n") >= least)).toPandas()
    key = found["key"].to_numpy(np.int64).view(np.uint64)
    if not len(key):
        return NO_PLAN
    hot = np.sort(key[found["n"].to_numpy() >= least])
    spread = np.sort(np.repeat(key, found["picked"].to_numpy(np.int64)))
    return Plan(np.unique(spread[(np.arange(1, buckets) * len(spread)) // buckets]), hot)


# ---- entries as bytes: numbers in byte planes, which compress where high bytes repeat ----------------


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw[: n * width], np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


_WIDTHS = {"key": 8, "hash": 8, "value": 8, "number": 4, "first": 4, "size": 4}


def packed(ids: np.ndarray, tags: np.ndarray, owner: np.ndarray, rest: bytes = b"", **columns: np.ndarray) -> bytes:
    """Entries of one bucket; ``owner`` are places in ids and tags."""
    docs, doc = np.unique(owner, return_inverse=True)
    head = np.array([len(docs), len(owner)], "<u8").tobytes()
    body = [_planes(ids[docs].view(np.uint64), 8), _planes(tags[docs].view(np.uint64), 8), _planes(doc, 4)]
    return b"".join([head, *body, *[_planes(v, _WIDTHS[k]) for k, v in columns.items()], rest])


def unpacked(blobs: list[bytes], names: list[str]) -> tuple[dict[str, np.ndarray], bytes]:
    """All entries of a bucket: id, tag and place of the document, and the named columns; the rest joined."""
    entries, rests, places = [], [], 0
    for blob in blobs:
        n_docs, n = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
        raw, out = memoryview(blob)[16:], {}
        ids, raw = _unplanes(raw, n_docs, 8).view(np.int64), raw[8 * n_docs :]
        tags, raw = _unplanes(raw, n_docs, 8).view(np.int64), raw[8 * n_docs :]
        doc, raw = _unplanes(raw, n, 4).astype(np.int64), raw[4 * n :]
        out |= {"id": ids[doc], "tag": tags[doc], "doc": doc + places}
        places += n_docs
        for name in names:
            out[name], raw = _unplanes(raw, n, _WIDTHS[name]), raw[_WIDTHS[name] * n :]
        entries.append(out)
        rests.append(bytes(raw))
    return {k: np.concatenate([e.pop(k) for e in entries]) for k in ("id", "tag", "doc", *names)}, b"".join(rests)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


def _per_document(doc: np.ndarray, ids: np.ndarray, tags: np.ndarray, values: np.ndarray) -> list[pa.Array]:
    """Columns doc_id, tag and the list of values of each place in ``doc``."""
    order = np.argsort(doc, kind="stable")
    heads = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1])) if len(doc) else np.empty(0, np.int64)
    first = order[heads]
    counts = np.diff(np.append(heads, len(doc)))
    return [pa.array(ids[first], pa.int64()), pa.array(tags[first], pa.int64()), _lists(counts, values[order])]


# ---- 1: regions that documents share ---------------------------------------------------------------

_REGION_ROWS = "bucket int, blob binary, doc_id long, tag long, codes array<long>"
_CODES = "doc_id long, tag long, codes array<long>"


def _bucketed(bucket: np.ndarray, plan: Plan) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted column and where its entries are."""
    bounds = np.searchsorted(bucket, np.arange(plan.buckets + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        yield int(i), slice(bounds[i], bounds[i + 1])


def _passed_on(buckets: list[int], blobs: dict[str, list[bytes]], own: list[pa.Array], plan: Plan, name: str) -> pa.RecordBatch:
    """Blobs for their buckets, and what is known already, spread over the buckets."""
    n, m = len(buckets), len(own[0])
    spread = (np.arange(m) % plan.buckets).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((np.array(buckets, np.int32), spread))),
            *(pa.array(x + [None] * m, pa.binary()) for x in blobs.values()),
            *(pa.concat_arrays([pa.nulls(n, x.type), x]) for x in own),
        ],
        ["bucket", *blobs, "doc_id", "tag", name],
    )


def _send_regions(plan: Plan, length: int, lead: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 2, PART_BYTES)):
            b = Batch(batch.column(2), plan, length, lead)
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mine = ids[b.owner]
            order = np.lexsort((mine, b.hash, b.key))
            new = np.ones(len(order), bool)
            new[1:] = (b.key[order][1:] != b.key[order][:-1]) | (b.hash[order][1:] != b.hash[order][:-1])
            later = np.zeros(len(order), bool)
            if len(order):
                later[order] = mine[order] > mine[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            solved, sent = np.flatnonzero(later), np.flatnonzero(~later)
            sent = sent[np.argsort(b.bucket[sent], kind="stable")]
            used, blobs = [], []
            for i, at in _bucketed(b.bucket[sent], plan):
                e = sent[at]
                used.append(i)
                blobs.append(packed(ids, tags, b.owner[e], number=b.number[e], key=b.key[e], hash=b.hash[e]))
            own = _per_document(b.owner[solved], ids[b.owner[solved]], tags[b.owner[solved]], codes_of(b.bucket[solved], b.number[solved], 0))
            yield _passed_on(used, {"blob": blobs}, own, plan, "codes")

    return send


def _compare_regions(plan: Plan):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Sort a bucket by key, region and document; name the regions that are solved or open. A hot key's other regions
        are in other buckets, so all that are not solved are open."""
        blobs = [x for x in table.column("blob").to_pylist() if x is not None]
        passed = table.filter(pa.compute.is_valid(table.column("doc_id"))).select(["doc_id", "tag", "codes"])
        if not blobs:
            return passed
        e, _ = unpacked(blobs, ["number", "key", "hash"])
        order = np.lexsort((e["id"], e["hash"], e["key"]))
        k, h, d = e["key"][order], e["hash"][order], e["id"][order]
        new_key = np.append(True, k[1:] != k[:-1])
        new_region = new_key | np.append(True, h[1:] != h[:-1])
        heads = np.flatnonzero(new_region)
        smallest = d[heads][np.cumsum(new_region) - 1]
        key_of_region = (np.cumsum(new_key) - 1)[heads]
        starts = np.flatnonzero(np.append(True, key_of_region[1:] != key_of_region[:-1]))
        mixed = np.minimum.reduceat(d[heads], starts) != np.maximum.reduceat(d[heads], starts)
        solved = d > smallest
        mixed |= plan.is_hot(k[heads][starts])
        is_open = ~solved & mixed[np.cumsum(new_key) - 1]
        some = np.flatnonzero(solved | is_open)
        at = order[some]
        codes = codes_of(int(key[0].as_py()), e["number"][at], is_open[some].astype(np.int64))
        found = pa.Table.from_arrays(_per_document(e["doc"][at], e["id"][at], e["tag"][at], codes), ["doc_id", "tag", "codes"])
        return pa.concat_tables([passed.cast(found.schema), found])

    return compare


# ---- 2: windows of open regions -------------------------------------------------------------------

_WINDOW_ROWS = "bucket int, blob binary, hot binary, doc_id long, tag long, ranges array<long>"
_RANGES = "doc_id long, tag long, ranges array<long>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a column of lists; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(doc: np.ndarray, ids: np.ndarray, tags: np.ndarray, start: np.ndarray) -> list[pa.Array]:
    """Columns doc_id, tag and the runs of window starts of each place in ``doc``; ids and tags are per start."""
    by_place = np.lexsort((start, doc))
    doc, start = doc[by_place], start[by_place].astype(np.int64)
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (np.diff(start) > 1))) if len(doc) else np.empty(0, np.int64)
    tails = np.append(heads[1:], len(doc))[: len(heads)] - 1
    of = by_place[heads]
    return _per_document(doc[heads], ids[of], tags[of], (start[heads] << 32) | start[tails])


def _later(value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the value too."""
    order = np.lexsort((ids, value))
    v, d = value[order], ids[order]
    new = np.append(True, v[1:] != v[:-1])[: len(v)]
    later = np.zeros(len(v), bool)
    if len(v):
        later[order] = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return later


def _send_windows(plan: Plan, length: int, lead: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 2, PART_BYTES)):
            owner, code = _flat(batch.column(3))
            want = (code & 1) == 1
            b = Batch(batch.column(2), plan, length, lead)
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            e = np.unique(b.at_code(owner[want], code[want]))
            is_hot = plan.is_hot(b.key[e])
            x = e[is_hot]
            counts = b.last[x].astype(np.int64) - b.first[x] + 1
            place, start = np.repeat(b.owner[x], counts), np.repeat(b.first[x], counts) + runs(counts)
            value = np.empty(len(place), np.uint64)
            for i, j in slices(b.at):
                mine = (place >= i) & (place < j)
                if mine.any():
                    value[mine] = Hasher(b.data[b.at[i] : b.at[j]]).windows(length)[start[mine] - b.at[i]]
            start = start - b.at[place]
            # Equal windows go once per batch, for the smallest document.
            known = _later(value, ids[place])
            own = _ranges(place[known], ids[place[known]], tags[place[known]], start[known])
            place, start, value = place[~known], start[~known], value[~known]
            bucket = (value % _U(plan.buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e = e[~is_hot]
            e = e[np.argsort(b.bucket[e], kind="stable")]
            used, blobs, hot = [], [], []
            for i, at in _bucketed(bucket[order], plan):
                y = order[at]
                used.append(i)
                blobs.append(None)
                hot.append(packed(ids, tags, place[y], value=value[y], first=start[y]))
            for i, at in _bucketed(b.bucket[e], plan):
                x = e[at]
                size = b.last[x] - b.first[x] + length
                content = b.data[np.repeat(b.first[x], size) + runs(size)].tobytes()
                used.append(i)
                blobs.append(packed(ids, tags, b.owner[x], content, first=b.first[x] - b.at[b.owner[x]], size=size))
                hot.append(None)
            yield _passed_on(used, {"blob": blobs, "hot": hot}, own, plan, "ranges")

    return send


def _compare_windows(length: int):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Sort all windows of a bucket by content and document; name those an earlier document has."""
        out = [table.filter(pa.compute.is_valid(table.column("doc_id"))).select(["doc_id", "tag", "ranges"])]

        def add(doc: np.ndarray, ids: np.ndarray, tags: np.ndarray, start: np.ndarray) -> None:
            out.append(pa.Table.from_arrays(_ranges(doc, ids, tags, start), ["doc_id", "tag", "ranges"]))

        hot = [x for x in table.column("hot").to_pylist() if x is not None]
        if hot:
            e, _ = unpacked(hot, ["value", "first"])
            hit = _later(e["value"], e["id"])
            add(e["doc"][hit], e["id"][hit], e["tag"][hit], e["first"][hit])
        blobs = [x for x in table.column("blob").to_pylist() if x is not None]
        if blobs:
            e, content = unpacked(blobs, ["first", "size"])
            size = e["size"].astype(np.int64)
            at = np.concatenate(([0], np.cumsum(size)))
            data = np.frombuffer(content, np.uint8)
            values, regions, offsets = [], [], []
            for a, b in slices(at):
                counts = size[a:b] - length + 1
                owner = np.repeat(np.arange(a, b), counts)
                offset = runs(counts)
                values.append(Hasher(data[at[a] : at[b]]).windows(length)[at[owner] - at[a] + offset])
                regions.append(owner)
                offsets.append(offset)
            value, region, offset = np.concatenate(values), np.concatenate(regions), np.concatenate(offsets)
            hit = np.flatnonzero(_later(value, e["id"][region]))
            of = region[hit]
            add(e["doc"][of], e["id"][of], e["tag"][of], e["first"][of].astype(np.int64) + offset[hit])
        return pa.concat_tables([x.cast(out[0].schema) for x in out])

    return compare


# ---- 3: what is removed ----------------------------------------------------------------------------


def _remove(plan: Plan, length: int, lead: int, keep_text: bool, carried: int):
    def cut(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Sizes, removed bytes, runs of removed bytes, and what stays of each text."""
        owner, code = _flat(batch.column(3))
        owner, code = owner[(code & 1) == 0], code[(code & 1) == 0]
        range_owner, window = _flat(batch.column(4))
        data, at = buffers(batch.column(2))
        marks = np.zeros(len(data) + 1, np.int32)
        if len(code):
            b = Batch(batch.column(2), plan, length, lead)
            e = b.at_code(owner, code)
            np.add.at(marks, b.first[e], 1)
            np.add.at(marks, b.last[e] + length, -1)
        np.add.at(marks, at[range_owner] + (window >> 32), 1)
        np.add.at(marks, at[range_owner] + (window & 0xFFFFFFFF) + length, -1)
        gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
        before = np.concatenate(([0], np.cumsum(gone, dtype=np.int32)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = at[(at > 0) & (at < len(data))]
        opens[inner] = gone[inner]
        spans = np.concatenate(([0], np.cumsum(opens, dtype=np.int32)))
        n_removed, n_spans = np.diff(before[at]).astype(np.int64), np.diff(spans[at]).astype(np.int64)
        kept = []
        for i in range(batch.num_rows):
            piece = data[at[i] : at[i + 1]]
            kept.append((piece[~gone[at[i] : at[i + 1]]] if n_removed[i] else piece).tobytes())
        return np.diff(at), n_removed, n_spans, kept

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 2, SLICE_BYTES)):
            sizes, n_removed, n_spans, kept = cut(batch)
            columns = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(n_removed), pa.array(n_spans)]
            if keep_text:
                columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
            else:
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
            extra = range(5, 5 + carried)
            columns += [batch.column(i) for i in extra]
            names = ["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept", *[batch.schema.names[i] for i in extra]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return remove


def tag_of(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not the text: a whole 64-bit hash, since a table may have many rows of one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, tag, n_bytes, n_removed, n_spans and what is kept of every row of (doc_id, text).

    Each byte goes that a ``length``-byte string covers which also starts in a document of a smaller doc_id; strings
    are judged on the input. ``kept`` is the sha256 of the remaining bytes, or with ``keep_text`` the
    remaining text without the rests of characters that a cut goes through. A null text is empty. A row
    with a null doc_id comes after all others. Rows that share a doc_id don't remove each other's bytes.
    Texts shorter than ``length`` stay whole. Other columns are not read, but for those that
    ``carry`` names: they come back with an underscore in front.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = size // BUCKET_BYTES + 1
    plan = plan_of(rows, n, buckets, length, lead)
    extra = [f"_{c}" for c in carry]
    tagged = rows.withColumn("tag", tag_of(F.col("text"))).select("doc_id", "tag", "text", *extra)
    sent = tagged.select("doc_id", "tag", "text").mapInArrow(_send_regions(plan, length, lead), _REGION_ROWS)
    codes = saved(sent.groupBy("bucket").applyInArrow(_compare_regions(plan), _CODES), "codes")
    per_doc = codes.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    # One exchange of the texts serves both passes below.
    texts = tagged.repartition(buckets, "doc_id", "tag")
    held = texts.join(per_doc, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "codes", *extra)
    asking = held.select("doc_id", "tag", "text", "codes").where(F.exists("codes", lambda c: c % 2 == 1))
    windows = asking.mapInArrow(_send_windows(plan, length, lead), _WINDOW_ROWS)
    ranges = windows.groupBy("bucket").applyInArrow(_compare_windows(length), _RANGES)
    found = ranges.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    whole = held.join(found, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "codes", "ranges", *extra)
    schema = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept string" + "".join(f", `{c}` {tagged.schema[c].dataType.simpleString()}" for c in extra)
    out = whole.mapInArrow(_remove(plan, length, lead, keep_text, len(extra)), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with all their columns and the text that ``remove_repeats`` leaves; ``n_chars`` is counted anew."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, length, keep_text=True, carry=rest)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[made.get(c, F.col(f"_{c}")).alias(c) for c in docs.columns])

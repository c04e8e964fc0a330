"""Repeated windows across a corpus: the part that op8 (bytes) and op10 (words) share.

Two equal windows have equal minimisers, so it is enough to compare windows
within a minimiser's bucket, and consecutive windows with one minimiser travel
together as one string, a super-k-mer:

1. Minimisers are counted over the whole corpus; those that occur once are done.
2. A bitmap of the others goes to the tasks (its size is checked; beyond it, a
   semi-join does the same), which send the super-k-mers of shared minimisers.
   Copies are counted on the way, so a bucket gets each string once.
3. A solver looks at each bucket and returns which parts of each string hold
   windows that start elsewhere too. A string that occurs twice is covered whole.
   Minimisers counted more than WIDE times would make one task's bucket too large.
   Their strings are dealt out by their own hash instead, and their windows are
   counted one by one in a shuffle of their own.
4. Its answers go back to the places where the strings occur, and per document
   to the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import checkpointed, shuffle_partitions

#: Above this many shared minimisers (a bitmap of 32 MB) a semi-join replaces the bitmap.
BITMAP_KEYS = 1 << 24
BITS_PER_KEY, PAGE_BITS = 16, 1 << 18
#: A minimiser that occurs more often has no bucket; so a bucket has at most so many strings (some 4 MB).
WIDE = 8192
#: Bytes of strings that a solver takes at once.
SOLVE_BYTES = 1 << 20

SENT = pa.schema([("anchor", pa.int64()), ("wide", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.binary()), ("n", pa.int64())])
PLACES = pa.schema([("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


class Symbols:
    """How a slice of texts becomes a sequence of symbols; `pack` gives the bytes of a run of them."""

    def __init__(self, kind: str, window: int, gram: int):
        self.kind, self.window, self.gram = kind, window, gram

    def runs(self, batch: pa.RecordBatch):
        """Yields for each slice: rows, starts, ends (in the text's symbols), anchors, two hashes, a packer."""
        data, offsets = V.texts(batch)
        if self.kind == "bytes":
            for row, local, at in V.slices(offsets, self.window - 1):
                piece = data[at : at + local[-1]]
                symbols = V.byte_table(1)[piece]
                base = np.concatenate([[at - offsets[row]], np.zeros(len(local) - 2, np.int64)]) if len(local) > 1 else local
                yield self._found(symbols, local, row, base, lambda a, b, p=piece: p[a:b].tobytes())
        else:
            # pieces of a text that is longer than a slice are cut in words, so they share their last words
            for row, local, at in V.slices(offsets):
                if local[-1] > V.SLICE or int(offsets[row + 1] - offsets[row]) > V.SLICE:
                    if at == offsets[row]:
                        yield from self._long(data[at : int(offsets[row + 1])], row)
                    continue
                piece = data[at : at + local[-1]]
                starts, ends, rows = V.words(piece, local)
                symbols = V.word_hashes(piece, starts, ends)
                yield self._found(symbols, rows, row, np.zeros(len(local) - 1, np.int64), lambda a, b, p=piece, s=starts, e=ends: b" ".join(p[s[a] : e[b - 1]].tobytes().split()))

    def _long(self, text: np.ndarray, row: int):
        starts, ends, _ = V.words(text, np.array([0, len(text)]))
        step = V.SLICE // 8
        for first in range(0, max(1, len(starts) - self.window + 1), step):
            some = slice(first, first + step + self.window - 1)
            s, e = starts[some], ends[some]
            piece = text[s[0] : e[-1]]
            symbols = V.word_hashes(piece, s - s[0], e - s[0])
            yield self._found(symbols, np.array([0, len(s)]), row, np.array([first]), lambda a, b, p=piece, s=s, e=e: b" ".join(p[s[a] - s[0] : e[b - 1] - s[0]].tobytes().split()))

    def _found(self, symbols, local, row, base, pack):
        r, a, b, anchor = V.super_windows(symbols, local, self.window, self.gram)
        sums = [V.prefix_sums(symbols, 8), V.prefix_sums(V.mixed(symbols + np.uint64(977)), 9)]
        own = [V.span(s, a, b, k) for s, k in zip(sums, (8, 9), strict=True)]
        return row + r, a - local[r] + base[r] if len(r) else a, a, b, anchor.view(np.int64), own[0].view(np.int64), own[1].view(np.int64), pack


def _anchor_counts(symbols: Symbols):
    def run(batches):
        for batch in batches:
            got = [x[4] for x in symbols.runs(batch)]
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["anchor", "n"])

    return run


def _pages(bits: int):
    """Pages of the bitmap; all keys of a page are in one partition."""

    def run(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            at = bit_places(batch.column("anchor").to_numpy(), bits)
            for page in np.unique(at // PAGE_BITS).tolist():
                own = pages.setdefault(page, np.zeros(PAGE_BITS, bool))
                own[at[at // PAGE_BITS == page] % PAGE_BITS] = True
        for page, own in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["page", "own"])

    return run


def bit_places(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the bitmap; the keys' high bits must be spread evenly."""
    return (anchors.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def shared_keys(counts: DataFrame):
    """counts: anchor, n -> the anchors counted at least twice with their counts, and a test for them as a broadcast bitmap (None: too many)."""
    shared = checkpointed(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    return shared, bitmap(shared)


def bitmap(keys: DataFrame, always: bool = False):
    """keys: anchor -> a test for them as a broadcast bitmap; None if they are too many for one.

    With `always` there is a bitmap of the largest size even then; it only lets more pass.
    """
    spark = keys.sparkSession
    n = keys.count()
    if n > BITMAP_KEYS:
        if not always:
            return None
        n = BITMAP_KEYS
    bits = max(20, (n * BITS_PER_KEY).bit_length())
    page = F.shiftrightunsigned(F.shiftrightunsigned("anchor", 64 - bits), 18)
    pages = keys.repartition(shuffle_partitions(spark), page).mapInArrow(_pages(bits), "page long, own binary")
    out = bytearray((1 << bits) // 8)
    for row in pages.toLocalIterator():
        out[row.page * PAGE_BITS // 8 : (row.page + 1) * PAGE_BITS // 8] = row.own
    return bits, spark.sparkContext.broadcast(bytes(out))


def rows_in(rows: DataFrame, column: str, test) -> DataFrame:
    """The rows whose key passes the test (all, without one): fewer to shuffle before a join that decides."""
    if test is None:
        return rows

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_wanted(batch.column(column).to_numpy(zero_copy_only=False), test)))

    return rows.mapInArrow(run, rows.schema)


def _wanted(anchors: np.ndarray, test) -> np.ndarray:
    if test is None:
        return np.ones(len(anchors), bool)
    bits, bitmap = test
    at = bit_places(anchors, bits)
    own = np.frombuffer(bitmap.value, np.uint8)
    return (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _strings(symbols: Symbols, test, wide):
    """Strings of shared minimisers, each once a batch with its count; those of wide ones go by their own hash."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            rows: list[list] = []
            size = 0
            for _, _, a, b, anchor, h1, h2, pack in symbols.runs(batch):
                broad = _wanted(anchor, wide) if wide else np.zeros(len(anchor), bool)
                for k in np.flatnonzero(_wanted(anchor, test)).tolist():
                    key = (int(h1[k]), int(h2[k]))
                    if key in seen:
                        rows[seen[key]][5] += 1
                        continue
                    seen[key] = len(rows)
                    s = pack(int(a[k]), int(b[k]))
                    rows.append([key[0] if broad[k] else int(anchor[k]), bool(broad[k]), *key, s, 1])
                    size += len(s)
                if size > 1 << 22:
                    yield _table(rows, SENT)
                    seen, size, rows = {}, 0, []
            if rows:
                yield _table(rows, SENT)

    return run


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _places(symbols: Symbols, test):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for rows, start, a, b, anchor, h1, h2, _ in symbols.runs(batch):
                k = np.flatnonzero(_wanted(anchor, test))
                if len(k):
                    take = pa.array(rows[k])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[k]), pa.array(h1[k]), pa.array(h2[k]), ids.take(take), keys.take(take), pa.array(start[k].astype(np.int32)), pa.array((start + b - a)[k].astype(np.int32))], schema=PLACES)

    return run


SOLVED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("spans", pa.list_(pa.int32())), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64())])


def _solve(solver: Callable, symbols: Symbols):
    """Feeds the solver with buckets, SOLVE_BYTES at a time; the rows come sorted by anchor and string.

    What needs no solver is answered here: a string alone in its bucket, and
    buckets all of whose strings occur more than once. The windows of strings
    of wide minimisers go out one by one.
    """
    window = symbols.window

    def answers(buckets: list[list]):
        rows, out = [], []
        for own in buckets:
            if len(own) > 1 and any(x[3] == 1 for x in own):
                rows += own
            else:
                out += [(x[0], x[1], [0, -1], None, None, None) for x in own if x[3] > 1]
        if rows:
            found = solver([x[2] for x in rows], [x[3] for x in rows], window)
            out += [(x[0], x[1], spans, None, None, None) for x, spans in zip(rows, found, strict=True) if spans]
        return _table(out, SOLVED)

    def one_by_one(rows: list):
        data = np.frombuffer(b"".join(x[2] for x in rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in rows])])
        w1, w2, r = window_hashes(data, offsets, symbols.kind, window)
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        h1, h2, n = (np.array([x[k] for x in rows], np.int64)[r] for k in (0, 1, 3))
        spans = pa.ListArray.from_arrays(np.arange(0, 2 * len(r) + 1, 2, dtype=np.int32), pa.array(np.stack([place, place + window], 1).ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), spans, pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(n)], schema=SOLVED)

    def run(batches):
        held, apart, size, anchor = [], [], 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("anchor", "wide", "h1", "h2", "s", "n")]
            for a, wide, h1, h2, s, n in zip(*columns, strict=True):
                own = apart if wide else held[-1] if held and a == anchor else None
                if own and own[-1][0] == h1 and own[-1][1] == h2:
                    own[-1][3] += n
                    continue
                if size > SOLVE_BYTES and (wide or a != anchor):
                    # nothing that is held here can still grow
                    if apart:
                        yield one_by_one(apart)
                    if held:
                        yield answers(held)
                    held, apart, size, own = [], [], 0, None
                if wide:
                    apart.append([h1, h2, s, n])
                elif own is None or a != anchor:
                    held.append([[h1, h2, s, n]])
                else:
                    own.append([h1, h2, s, n])
                anchor = a if not wide else None
                size += len(s)
        if apart:
            yield one_by_one(apart)
        if held:
            yield answers(held)

    return run


def window_hashes(data: np.ndarray, local: np.ndarray, kind: str, window: int):
    """Two hashes of each window of each row of packed strings, and the row; in order."""
    if kind == "bytes":
        symbols, rows = V.byte_table(1)[data], local
    else:
        starts, ends, rows = V.words(data, local)
        symbols = V.word_hashes(data, starts, ends)
    valid = np.zeros(len(symbols) + 1, bool)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        valid[a : max(a, b - window + 1)] = True
    begins = np.flatnonzero(valid)
    sums = [V.prefix_sums(symbols, 11), V.prefix_sums(V.mixed(symbols + np.uint64(31)), 12)]
    return V.span(sums[0], begins, begins + window, 11), V.span(sums[1], begins, begins + window, 12), np.searchsorted(rows, begins, "right") - 1


def counted_windows(strings: list[bytes], counts: list[int], window: int, kind: str) -> list[list[int]]:
    """Repeated spans of each string: the windows of all are sorted by their hashes, and equal neighbours counted."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    w1, w2, row = window_hashes(data, offsets, kind, window)
    order = np.lexsort((w2, w1))
    differs = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
    group = np.concatenate([[0], np.cumsum(differs)])
    total = np.bincount(group, np.array(counts)[row[order]])
    repeated = np.zeros(len(row), bool)
    repeated[order] = total[group] > 1
    first = np.searchsorted(row, np.arange(len(strings) + 1))
    return [joined_spans(np.flatnonzero(repeated[a:b]), window) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def joined_spans(starts: np.ndarray, window: int) -> list[int]:
    """Sorted window starts -> flat list of maximal [start, end) spans."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    a, b = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + window
    return np.stack([a, b], 1).ravel().tolist()


def repeated_spans(docs: DataFrame, symbols: Symbols, solver: Callable) -> DataFrame:
    """docs: doc_id, text_key, text (no nulls) -> doc_id, text_key, spans (array of [start, end) in symbols, unordered, may overlap)."""
    shared, test = shared_keys(docs.select("text").mapInArrow(_anchor_counts(symbols), "anchor long, n long"))
    hot = shared.where(F.col("n") > WIDE).select("anchor")
    wide = bitmap(hot, always=True) if hot.head(1) else None
    semi = (lambda df: df) if test else (lambda df: df.join(shared.select("anchor"), "anchor", "left_semi"))
    n = shuffle_partitions(docs.sparkSession)
    sent = docs.select("text").mapInArrow(_strings(symbols, test, wide), "anchor long, wide boolean, h1 long, h2 long, s binary, n long")
    sent = sent if test else semi(sent.where("not wide")).unionByName(sent.where("wide"))
    answered = sent.repartition(n, "anchor").sortWithinPartitions("wide", "anchor", "h1", "h2").mapInArrow(_solve(solver, symbols), "h1 long, h2 long, spans array<int>, w1 long, w2 long, n long")
    answered = checkpointed(answered)
    solved = answered.where("w1 is null").select("h1", "h2", "spans")
    windows = answered.where("w1 is not null")
    if wide:
        again = windows.groupBy("w1", "w2").agg(F.sum("n").alias("c")).where("c > 1").drop("c")
        at = windows.join(again, ["w1", "w2"]).groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        solved = solved.unionByName(at)
    places = semi(docs.select("doc_id", "text_key", "text").mapInArrow(_places(symbols, test), "anchor long, h1 long, h2 long, doc_id long, text_key long, start int, end int"))
    # [0, -1] is the whole string
    found = places.drop("anchor").join(solved, ["h1", "h2"]).select("doc_id", "text_key", F.expr("transform(spans, x -> if(x < 0, end, x + start))").alias("spans"))
    return found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the column spans; rows that share id and text share it."""
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans").hint("shuffle_hash")
    return docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").select("doc_id", "text", "spans")


def merged(flat: list[int] | None) -> list[tuple[int, int]]:
    """Maximal spans, in order, of a flat unordered list of spans. Touching spans are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)) if flat else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]

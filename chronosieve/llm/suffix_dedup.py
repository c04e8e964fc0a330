"""Suffix-array deduplication with a run-length index.

Removes each byte that is covered by a WINDOW-byte string which starts anywhere
else too. The corpus is cut into buckets of super-k-mers (see repeats); what
meets in a bucket is repetitive, and is searched with a run-length index:

- the suffixes of the bucket's strings are sorted and give its Burrows-Wheeler
  transform, of which only runs of equal letters matter;
- at the head of each run the suffix and its match with the suffix before it are
  sampled (only these matches are compared letter by letter);
- all other matches follow from the samples: within a run, the match of the next
  text position is one shorter, so one pass over the text streams the matching
  statistics, the longest match of each position with any other.

Positions whose match reaches WINDOW start a repeated string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from . import repeats
from .common import load

WINDOW, GRAM = 400, 128


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling, first on as many letters as fit a number; letters are 1-255, larger ones are separators, all different."""
    n = len(text)
    letters, rank = np.unique(text, return_inverse=True)
    bits = (len(letters) + 1).bit_length()
    depth = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(min(depth, n)):
        key <<= bits
        key[: n - j] += rank[j:] + 1
    _, rank = np.unique(key, return_inverse=True)
    rank = rank.astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: max(0, n - depth)] += rank[depth:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order, rank
        depth *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text with samples at the run heads."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.order, self.rank = suffix_order(text)
        bwt = text[self.order - 1]
        heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.run_letters, self.run_starts = bwt[heads], heads
        self.samples = self.order[heads]
        self.sample_matches = self._compare(self.samples, np.where(heads > 0, self.order[heads - 1], n))

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b, all in step."""
        n = len(self.text)
        padded = np.concatenate([self.text, [-1]])
        length = np.zeros(len(a), np.int64)
        live = np.flatnonzero(np.maximum(a, b) < n)
        while len(live):
            x, y = a[live] + length[live], b[live] + length[live]
            live = live[(np.maximum(x, y) < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])]
            length[live] += 1
        return length

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match of what starts there with what starts anywhere else."""
        n = len(self.text)
        before = np.full(n, -1, np.int64)
        before[self.samples] = self.samples
        last = np.maximum.accumulate(before)
        sampled = np.zeros(n, np.int64)
        sampled[self.samples] = self.sample_matches
        places = np.arange(n)
        with_previous = np.where(last >= 0, np.maximum(sampled[last] - (places - last), 0), 0)
        with_next = np.zeros(n, np.int64)
        with_next[self.order[:-1]] = with_previous[self.order[1:]]
        return np.maximum(with_previous, with_next)


def solve(strings: list[bytes], counts: list[int], window: int) -> list[list[int]]:
    """Repeated spans of each string among all; a string that occurs more than once is repeated whole."""
    letters = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    lengths = np.array([len(s) for s in strings])
    ends = np.cumsum(lengths) + np.arange(len(strings))
    text = np.empty(len(letters) + len(strings), np.int64)
    mask = np.ones(len(text), bool)
    mask[ends] = False
    text[mask] = letters
    text[ends] = 256 + np.arange(len(strings))
    matches = RunIndex(text).matching_statistics()
    begins = np.flatnonzero(matches >= window)
    out, first = [], ends - lengths
    cuts = np.searchsorted(begins, np.stack([first, ends], 1))
    for k, n in enumerate(counts):
        if n > 1:
            out.append([0, int(lengths[k])])
        else:
            out.append(repeats.joined_spans(begins[cuts[k, 0] : cuts[k, 1]] - first[k], window))
    return out


def _finish(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for doc_id, text, flat in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = text.as_buffer() if text.as_buffer() is not None else b""
            view, spans = memoryview(data), repeats.merged(flat)
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(view[at:a])
                at = b
            kept.update(view[at:])
            rows.append((doc_id, len(view), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def repeated_bytes(docs, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM):
    """What to remove from each document.

    Returns a row for every row of `docs`: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (flat list of removed [start, end)). A null text counts as
    empty; texts under `window` bytes keep everything. Rows that repeat an id or
    have none are documents of their own. An empty table gives an empty result;
    other columns are ignored whatever their names.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeats.repeated_spans(rows, repeats.Symbols("bytes", window, gram), solve)
    return repeats.with_spans(rows, spans).mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op8(spark, sf_dir: str):
    return repeated_bytes(load(spark, sf_dir, "documents")).drop("spans")


ORACLE = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM b)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
o AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
p AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
q AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM p GROUP BY 1, 2),
e AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM (
    SELECT doc_id, a, z FROM q UNION ALL SELECT doc_id, n, n FROM b)),
k AS (SELECT e.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a, z) AS kept FROM e JOIN b USING (doc_id) WHERE a > from_ GROUP BY 1),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM q GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

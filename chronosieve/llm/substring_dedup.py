"""Substring deduplication by super-k-mer partitioning.

Removes each word that is covered by a window of WINDOW consecutive words whose
sequence starts anywhere else too. Consecutive windows that share a minimiser
travel as one packed string to the bucket of that minimiser (see repeats), where
the windows of all strings are sorted and equal neighbours counted.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa

from . import repeats
from .common import load

WINDOW, GRAM = 35, 12


def solve(strings: list[bytes], counts: list[int], window: int) -> list[list[int]]:
    """Repeated spans, in words, of each packed string: its windows are sorted together with all others'."""
    return repeats.counted_windows(strings, counts, window, "words")


def _finish(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for doc_id, text, flat in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, spans = text.split(), repeats.merged(flat)
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [x for s in spans for x in s]))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def repeated_words(docs, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM):
    """What to remove from each document.

    Returns a row for every row of `docs`: doc_id, n_words, n_removed,
    kept_sha256, spans (flat list of removed [start, end), in words). A null text
    has no words; texts of fewer than `window` words keep everything. Rows that
    repeat an id or have none are documents of their own. An empty table gives an
    empty result; other columns are ignored whatever their names.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeats.repeated_spans(rows, repeats.Symbols("words", window, gram), solve)
    return repeats.with_spans(rows, spans).mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>")


def op10(spark, sf_dir: str):
    return repeated_words(load(spark, sf_dir, "documents")).drop("spans")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r)),
l AS (SELECT doc_id, list(j) AS js FROM g GROUP BY 1),
k AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.j) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) w ANTI JOIN g ON w.doc_id = g.doc_id AND w.j = g.j GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""

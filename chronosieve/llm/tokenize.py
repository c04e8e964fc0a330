"""SentencePiece (merge type) encoding and decoding, exact, by backtracking.

A text is encoded greedily from the left with the longest piece that matches,
which Aho-Corasick finds for all places at once. The greedy choice is only kept
while each pair of neighbouring pieces is compatible, that is, if re-merging the
two pieces' characters gives back these two pieces; otherwise the next shorter
piece is tried, and if none is left the place is marked as failed in a bitfield
and the piece before it is given up. A sequence in which all neighbours are
compatible is what the merges give, so the first full sequence is the answer.

No piece holds a space after another character, and characters without a piece
(line ends among them) never merge, so texts fall into chunks that are encoded
on their own; a task remembers the chunks it meets often.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load

SPACE = "▁"
#: Chunks that a task remembers: so many in each of two generations, none longer than this.
REMEMBERED, LONGEST = 100_000, 48
_CHUNK = re.compile("\n| *[^ \n]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> tuple[list[str], list[float], dict[int, int], int]:
    """Pieces, scores (None: not a piece of text), ids of the byte pieces, id of the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k) for k in range(n)]
    pieces = [sp.id_to_piece(k) for k in range(n)]
    scores = [None if special[k] else sp.get_score(k) for k in range(n)]
    return pieces, scores, {int(pieces[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}, sp.unk_id()


class Codec:
    """Encodes and decodes with one vocabulary; small enough to be sent to tasks."""

    def __init__(self, pieces: list[str], scores: list, bytes_: dict[int, int], unknown: int):
        self.table = pieces, scores, bytes_, unknown
        self._ready = False

    @classmethod
    def from_file(cls, path: str) -> Codec:
        return cls(*read_model(path))

    def __reduce__(self):
        return Codec, self.table

    def _prepare(self) -> None:
        pieces, scores, self.byte_ids, self.unknown = self.table
        self.ids = {p: k for k, p in enumerate(pieces) if scores[k] is not None}
        self.score = {p: scores[k] for p, k in self.ids.items()}
        self.length = [len(p) for p in pieces]
        self.pieces = pieces
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, k in self.byte_ids.items():
            self.raw[k] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.matcher = ahocorasick.Automaton()
        for p, k in self.ids.items():
            if len(p) == 1 or self.merged(p) == [p]:  # others are never the result of merges
                self.matcher.add_word(p, k)
        self.matcher.make_automaton()
        # the next shorter piece that begins a piece, -1 if there is none
        usable = {p: self.ids[p] for p in self.matcher.keys()}
        self.shorter = [-1] * len(pieces)
        for p, k in usable.items():
            self.shorter[k] = next((usable[p[:j]] for j in range(len(p) - 1, 0, -1) if p[:j] in usable), -1)
        self.digits = list(map(str, range(len(pieces))))
        self.characters = {p for p in self.ids if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.young, self.old = {}, {}
        self._ready = True

    def merged(self, s: str) -> list[str]:
        """Merges the characters of a short string: best score first, leftmost of equals."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = score.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got > best):
                    best, at = got, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            p, q = self.pieces[a], self.pieces[b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            if len(self.pairs) >= 2 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(p + q) == [p, q]
        return known

    def _known(self, s: str) -> list[int]:
        """Ids of a string all of whose characters have pieces."""
        n = len(s)
        longest = [0] * n
        length, shorter, pairs = self.length, self.shorter, self.pairs
        for end, k in self.matcher.iter(s):  # by end, so the longest piece of a place comes last
            longest[end + 1 - length[k]] = k
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, last, k = 0, -1, longest[0]
        while True:
            while k >= 0:
                end = at + length[k]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | k)
                    if fits or fits is None and self.compatible(last, k):
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at, last = end, k
                if at == n:
                    return out
                k = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                k = out.pop()
                at -= length[k]
                last = out[-1] if out else -1
                k = shorter[k]

    def chunk(self, s: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and what they decode to."""
        if self.characters.issuperset(s):
            ids = self._known(s)
        else:
            ids, held = [], ""
            for c in s:
                if c in self.characters:
                    held += c
                    continue
                if held:
                    ids += self._known(held)
                    held = ""
                ids += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
            if held:
                ids += self._known(held)
        text = b"".join([self.raw[k] for k in ids]).decode("utf-8", "replace")
        return len(ids), ",".join([self.digits[k] for k in ids]), text

    def _look(self, s: str) -> tuple[int, str, str]:
        got = self.young.get(s)
        if got is None:
            got = self.old.get(s) or self.chunk(s.replace(" ", SPACE))
            if len(s) <= LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[s] = got
        return got

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text. The empty text has no ids."""
        if not self._ready:
            self._prepare()
        if not text:
            return 0, "", ""
        chunks = _CHUNK.findall(" " + text.replace(SPACE, " "))
        found = list(map(self.young.get, chunks))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    found[k] = self._look(chunks[k])
        decoded = "".join([x[2] for x in found])
        return sum([x[0] for x in found]), ",".join([x[1] for x in found]), decoded[1:] if decoded[:1] == " " else decoded

    def decode(self, ids: list[int]) -> str:
        """Text of any sequence of ids; bytes that form no character become U+FFFD."""
        if not self._ready:
            self._prepare()
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def tokenized(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`; with_ids adds ids and decoded.

    A null text counts as empty, which has no ids. Rows that repeat an id or have
    none are encoded like any other; an empty table gives an empty result; other
    columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        encode = shared.value.encode
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                n, ids, decoded = encode(t.as_py() or "")
                # digests at once: the texts of a whole batch need not be held twice
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids, decoded) if with_ids else ())))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([x[0] for x in rows], pa.int64()),
                "ids_sha256": pa.array([x[1] for x in rows], pa.string()),
                "decoded_sha256": pa.array([x[2] for x in rows], pa.string()),
            }
            if with_ids:
                columns |= {"ids": pa.array([[int(k) for k in x[3].split(",")] if x[3] else [] for x in rows], pa.list_(pa.int32())), "decoded": pa.array([x[4] for x in rows], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op1(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    return tokenized(load(spark, sf_dir, "documents"), Codec.from_file(model or default_model()))

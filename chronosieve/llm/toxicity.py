"""Toxicity by compression distance, with dictionaries that zstandard trains on toxic and on ordinary text.

A window is a word of the running text between two marks HEAD. Fitting takes a
bounded sample of labelled documents, near copies once:

- the toxic dictionary is trained on the windows that recur in toxic documents and
  hardly occur in ordinary ones (all of them, as often as documents have them), the
  ordinary dictionary on windows of ordinary documents, to the same size; both stand
  before one more dictionary of ordinary windows, so that ordinary language costs both
  the same;
- a window's gain is its compression length with the ordinary dictionary less that
  with the toxic one. HEAD is as long as the context in which zstandard counts
  (eight bytes, one of them the window's), so what it picks begins with HEAD, and a
  window that begins like a toxic one saves as many bytes as they share;
- a document is described by its largest gains, the share of its windows with clear
  gains, and its length; a logistic regression calibrates this to a probability.
  The documents it learns from were not in the dictionaries that measure them:
  dictionaries are trained FOLDS times, each time without the part to be measured.

Windows of single words are sharpest: in longer ones, ordinary words add noise to the
difference of two lengths (the README has figures).
"""

from __future__ import annotations

import random
import string
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load

#: The classifier is fitted on so many toxic and ordinary documents at most, taken in the order of a hash, and on so many bytes of each kind.
FIT_DOCUMENTS, FIT_BYTES = {1: 1500, 0: 4000}, 16_000_000
HEAD = b"\n<of> ~"
#: A window recurs if so many toxic documents have it, and is telling if it is so many times as frequent there.
RECURS, TELLING = 3, 12
TRAIN_BYTES, SHARED_BYTES, ORDINARY_WINDOWS = 1 << 16, 1 << 14, 200_000
LEVEL, FOLDS, CLEAR, HIGH = 13, 3, 3, 6
#: Marking an ordinary document counts as so many misses.
COST = 1.0
#: Longer runs without a space are looked at in overlapping windows.
RUN, PIECE, STEP = 40, 16, 4
#: Gains of so many different words are remembered by a task.
REMEMBERED = 200_000
#: Stands for the gain of a run without a window.
NOTHING = -(1 << 40)
#: Odd multipliers of the min-hashes that tell near copies in the sample.
MARKS = (815, 31_337, 77_003, 90_001, 524_287, 611_953, 1_299_709, 7_368_787)
#: Punctuation in any script.
EDGES = "".join(c for c in map(chr, range(0x3100)) if c in string.punctuation or unicodedata.category(c)[0] in "PS")


def windows_of(run: str) -> list[str]:
    """The windows of a lower-cased run of text without spaces: itself without punctuation at its ends, or pieces of it if it is long."""
    w = run.strip(EDGES)
    if len(w) <= RUN:
        return [w] if w else []
    return [w[k : k + PIECE] for k in range(0, len(w) - PIECE + STEP, STEP)]


def windows(text: str) -> list[str]:
    """The words of a text, lower-cased, without punctuation at their ends; long runs in overlapping pieces."""
    return [w for run in text.lower().split() for w in windows_of(run)]


def framed(word: str) -> bytes:
    return HEAD + word.encode("utf-8", "replace") + HEAD


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary as zstandard trains it, of `size` bytes at most; too few samples for that: their end."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=24, d=len(HEAD) + 1, level=3).as_bytes()[-size:]
        except zstandard.ZstdError:
            size //= 2
    return b"".join(samples)[-256:]


def once(docs: list[list[str]]) -> list[int]:
    """Which documents are no near copies of earlier ones, told by eight min-hashes of their windows."""
    seen, out = set(), []
    for k, d in enumerate(docs):
        hashes = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in set(d)], np.uint64)
        marks = [(m, int((hashes * np.uint64(2 * m + 1) % np.uint64(4_294_967_291)).min(initial=0xFFFFFFFF))) for m in MARKS]
        if sum(m in seen for m in marks) < 6 or not d:
            out.append(k)
        seen.update(marks if d else ())
    return out


class Distance:
    """The two dictionaries, and what is measured with them."""

    def __init__(self, toxic: bytes, ordinary: bytes, shared: bytes):
        # both are equally long, so places in them cost the same
        size = max(len(toxic), len(ordinary))
        self.contents = tuple(x.rjust(size, b"\x00") + shared for x in (ordinary, toxic))
        self._known: dict[str, int] = {}
        self._pair = None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, state):
        self.contents, self._known, self._pair = state, {}, None

    def lengths(self):
        """Two functions: the compression length of a framed window with the ordinary and with the toxic dictionary."""
        made = []
        for content in self.contents:
            shape = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=shape)
            compress = zstandard.ZstdCompressor(dict_data=known, compression_params=shape).compress
            made.append(lambda x, compress=compress: len(compress(x)))
        return made

    def gain(self, window: str) -> int:
        if self._pair is None:
            self._pair = self.lengths()
        x = framed(window)
        return self._pair[0](x) - self._pair[1](x)

    def gains(self, text: str) -> np.ndarray:
        """The gains of all windows of a text. Runs without a space are remembered, as texts repeat them."""
        known, more = self._known, []
        runs = text.lower().split()
        found = list(map(known.get, runs))
        if None in found:
            for k, g in enumerate(found):
                if g is None and (g := known.get(runs[k])) is None:
                    own = [self.gain(w) for w in windows_of(runs[k])]
                    g = own[0] if own else NOTHING
                    if len(own) > 1:  # a long run, not remembered
                        more += own[1:]
                    elif len(known) < REMEMBERED:
                        known[runs[k]] = g
                found[k] = g
        g = np.array(found + more, np.int64)
        return g[g != NOTHING]

    def forget(self) -> None:
        """Called when a task ends: Python workers live on, and so would what they remember."""
        self._known, self._pair = {}, None

    def features(self, text: str) -> list[float]:
        """Largest gains, shares of clear and of high gains, and the length."""
        g = self.gains(text)
        top = np.sort(np.concatenate([g, np.zeros(3, np.int64)]))[::-1][:3]
        n = len(g)
        return [*map(float, top), 10 * float(g[g >= CLEAR].sum()) / (n + 20), 10 * float(g[g >= HIGH].sum()) / (n + 20), float(np.log1p(n)), float(top[0] * np.log1p(n))]


class Model:
    """A distance and its calibration; small enough to travel with a task. Without a distance every score is `constant`."""

    def __init__(self, distance: Distance | None, weights: np.ndarray | None = None, constant: float = 0.0):
        self.distance, self.weights, self.constant = distance, weights, constant

    def forget(self) -> None:
        if self.distance is not None:
            self.distance.forget()

    def score(self, text: bytes | str) -> float:
        if self.distance is None:
            return self.constant
        text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        return float(_probability(np.array([self.distance.features(text)]), self.weights)[0])


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    mean, scale, w = weights
    z = np.c_[(x - mean[:-1]) / scale[:-1], np.ones(len(x))] @ w
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean, scale and weight of each feature (the last is the constant) by logistic regression with a small penalty. Features that hardly vary are not stretched."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.5)
    z, cost = np.c_[(x - mean) / scale, np.ones(len(x))], np.where(y == 1, 1.0, COST)
    w, penalty = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (cost * (y - p)) - penalty @ w)
    return np.stack([np.append(mean, 0.0), np.append(scale, 1.0), w])


def distance_of(toxic: list[list[str]], ordinary: list[list[str]]) -> Distance:
    """The dictionaries, trained on windows of documents of both kinds."""
    n_toxic, n_plain = (Counter(w for d in docs for w in set(d)) for docs in (toxic, ordinary))
    telling = {w for w, n in n_toxic.items() if n >= RECURS and n * len(ordinary) > TELLING * (n_plain[w] + 0.5) * len(toxic)}
    draw = random.Random(4)
    usual = [w for d in ordinary for w in d]
    draw.shuffle(usual)
    bad = trained([framed(w) for d in toxic for w in sorted(set(d) & telling)], TRAIN_BYTES) if telling else b""
    good = trained([framed(w) for w in usual[ORDINARY_WINDOWS : 2 * ORDINARY_WINDOWS] or usual], max(1024, len(bad)))
    return Distance(bad, good, trained([framed(w) for w in usual[:ORDINARY_WINDOWS]], SHARED_BYTES))


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model from a sample of texts of both kinds. Without toxic or without ordinary texts every score is 0 or 1."""
    if not toxic or not ordinary:
        return Model(None, constant=1.0 if toxic else 0.0)
    kinds = []
    for texts in (ordinary, toxic):
        texts = [t.decode("utf-8", "replace") for t in texts]
        docs = [windows(t) for t in texts]
        kinds.append([(texts[k], docs[k]) for k in once(docs)])
    x, y = [], []
    folds = FOLDS if min(map(len, kinds)) >= 2 * FOLDS else 1
    for k in range(folds):
        # too few documents for folds: they calibrate what they trained
        rest = [[d for i, (_, d) in enumerate(docs) if folds == 1 or i % folds != k] for docs in kinds]
        distance = distance_of(rest[1], rest[0])
        for kind, docs in enumerate(kinds):
            x += [distance.features(t) for t, _ in docs[k::folds]]
            y += [kind] * len(docs[k::folds])
    return Model(distance_of(*([d for _, d in docs] for docs in kinds[::-1])), _calibrated(np.array(x), np.array(y)))


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents whose crc32(doc_id) mod 5 is not 0: a bounded sample in the order of a hash."""
    own = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    drawn = None
    for kind, n in FIT_DOCUMENTS.items():
        some = own.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        drawn = some if drawn is None else drawn.unionByName(some)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    size = {0: 0, 1: 0}
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    for row in sample.toLocalIterator():
        data = row.text.encode()
        if size[row.toxic] + len(data) <= FIT_BYTES:
            texts[row.toxic].append(data)
            size[row.toxic] += len(data)
    return fit(texts[1], texts[0])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    A null text counts as empty; empty texts get the score of no gains and no
    length. A null id is not held out. Repeated rows are scored alike, an empty
    table gives an empty result, other columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.score
        for batch in batches:
            ids = batch.column("doc_id")
            texts = batch.column("text").fill_null("").cast(pa.binary())
            held = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in ids.to_pylist()]
            scores = [score(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])
        shared.value.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score under 0.5, with all their columns; see score_texts for the cases."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.score
        for batch in batches:
            texts = batch.column(text_col).fill_null("").cast(pa.binary())
            yield batch.filter(pa.array([score(t.as_py()) < 0.5 for t in texts], pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_texts(docs, learnt(docs, load(spark, sf_dir, "labels")))

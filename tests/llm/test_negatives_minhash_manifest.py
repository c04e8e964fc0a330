"""Hard negatives, near duplicates by sketches, and the manifest, against brute force on edge cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import FOLD, SCHEMA, counted, docs, edge, empty, real, words  # noqa: F401

from chronosieve.llm import manifest, minhash, negatives, ngram_join, surrogates

VECTORS = "vec_id long, embedding array<float>, label int, score string, anchor_id int, v int"


def brute_negatives(rows):
    fine = {(i, n, tuple(math.floor(256 * x) for x in v)) for i, v, n, *_ in rows if None not in (i, v, n) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, v in sorted(fine):
        if a % 3:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, n) for i, n, w in fine if len(v) == len(w)]
        for ps, p, _ in sorted(x for x in scored if x[2] == label and x[1] != a)[:5]:
            good = sorted(x for x in scored if x[2] != label and -80 * ps <= -100 * x[0] <= -100 * ps)[:5]
            out += [(a, p, k + 1, x[1], -ps, -x[0]) for k, x in enumerate(good)]
    return out


def vector_rows(seed):
    rnd = random.Random(seed)
    near = lambda c: [x + rnd.gauss(0, 0.2) for x in c]
    middle = [rnd.gauss(0, 1) for _ in range(6)]
    rows = [(k, [float(np.float32(x)) for x in near(middle)], rnd.randint(0, 2), "s", 1, 2) for k in range(60)]
    rows += [(100 + k, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25], k % 3, None, None, None) for k in range(40)]  # ties
    rows += [rows[0], rows[0], (3, [0.5] * 6, 1, "", 0, 0), (6, None, 1, "", 0, 0), (9, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "", 0, 0), (12, [math.nan] * 6, 1, "", 0, 0), (15, [math.inf] * 6, 0, "", 0, 0)]
    rows += [(18, [0.5] * 6, None, "", 0, 0), (None, [0.5] * 6, 1, "", 0, 0), (21, [0.25, 1.0], 1, "", 0, 0), (24, [0.25, 0.75], 1, "", 0, 0), (25, [0.25, 0.7], 2, "", 0, 0), (30, [], 1, "", 0, 0), (33, [0.0] * 6, 1, "", 0, 0)]
    return rows


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 16)])
def test_hard_negatives(spark, blocks, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[0]), monkeypatch.setattr(negatives, "VECTOR_BLOCK", blocks[1])
    rows = vector_rows(3)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = negatives.hard_negatives(df, df.where(F.col("vec_id") % 3 == 0))
    assert counted(tuple(r) for r in got.collect()) == counted(brute_negatives(rows)) and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.hard_negatives(df.where("false"), df.where("false")).collect() == [] == negatives.hard_negatives(df, df.where("false")).collect()


def test_scores_are_exact_beyond_doubles():
    a = np.array([[2.0**40, 3.0], [-(2.0**40), 1.0]])
    with pytest.raises(OverflowError):
        negatives.products(a, a)
    b = np.array([[2.0**27 + 1, 5.0]])
    assert negatives.products(b, b).tolist() == [[(2**27 + 1) ** 2 + 25]]


def test_a_stream_holds_windows_only():
    keys = [((0, 0, -100, 0, 7), None), *(((0, 0, -100, 1, k), None) for k in range(3)), ((0, 0, -90, 0, 8), None), *(((0, 0, -85, 1, k), None) for k in range(10, 14)), ((0, 0, -79, 1, 20), None), ((5, 0, -79, 1, 20), None)]
    got = list(negatives.streamed(5, 80, 100)(iter(keys)))
    assert got == [(0, 7, 1, 0, 100, 100), (0, 7, 2, 1, 100, 100), (0, 7, 3, 2, 100, 100), (0, 7, 4, 10, 100, 85), (0, 8, 1, 10, 90, 85), (0, 7, 5, 11, 100, 85), (0, 8, 2, 11, 90, 85), (0, 8, 3, 12, 90, 85), (0, 8, 4, 13, 90, 85), (0, 8, 5, 20, 90, 79)]


def brute_components(rows, shingle, percent):
    sets = [frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset() for w in (words((r[1] or "").translate(FOLD)) for r in rows)]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(rows[k][0])
    for k, r in enumerate(rows):
        least = min((x for x in groups[top(k)] if x is not None), default=None)
        yield r[0], len(sets[k]), least, r[0] == least


def near_copies(seed, size):
    """A large group of texts that are near copies of one or of each other, some just below the threshold."""
    rnd = random.Random(seed)
    base = [rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(90)]
    rows = []
    for k in range(size):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5])):
            text[rnd.randrange(len(text))] = f"x{rnd.randint(0, 99)}"
        rows.append((size - k, " ".join(text), None, None, None, None, None, None))
    return rows


@pytest.mark.parametrize("limits", [(256, 1 << 20, 4096), (4, 200, 16)])
def test_near_duplicates_in_a_large_group(spark, limits, monkeypatch):
    monkeypatch.setattr(minhash, "CAP", limits[0]), monkeypatch.setattr(minhash, "TOKENS", limits[1]), monkeypatch.setattr(minhash, "BLOCK", limits[2])
    rows = near_copies(7, 150)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert counted(tuple(r) for r in got.collect()) == counted(brute_components(rows, 4, 80))


def test_near_duplicates(docs):  # noqa: F811
    df, rows = docs
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert counted(tuple(r) for r in got.collect()) == counted(brute_components(rows, 4, 80))


def test_near_duplicates_of_nothing(empty):  # noqa: F811
    assert minhash.near_duplicates(empty).collect() == []


def test_sketches_estimate_high_similarities():
    rnd = np.random.default_rng(2)
    for share in (0.7, 0.8, 0.9, 0.97):
        off = []
        for _ in range(30):
            common, own = rnd.integers(0, 1 << 63, int(1000 * share), np.uint64), rnd.integers(0, 1 << 63, (2, 500 - int(500 * share)), np.uint64)
            a, b = (np.sort(np.concatenate([common, x])) for x in own)
            _, bands, odd = minhash.sketched(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            ones = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
            assert share < 0.8 or (ones <= minhash.most_ones(80) and (bands[0] == bands[1]).any())
            off.append(minhash.similarity(ones) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(off)) < 0.03
    assert minhash.similarity(0) == 1 and isinstance(ngram_join.CAP, int)


def brute_manifest(rows):
    low = lambda t: None if t is None else t.translate(FOLD)
    code = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r, text: sha("".join(code(x) for x in (r[0], r[3], r[2], r[4], text)))

    def grown(nodes):
        """[(node, [(leaf place, path)])]: paths list (others before, others after)."""
        level, at, up = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
        while len(level) > 1:
            for k in range(len(nodes)):
                start = at[k] - at[k] % 16
                up[k].append((level[start : at[k]], level[at[k] + 1 : start + 16]))
                at[k] //= 16
            level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        return level[0], up

    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, tops = grown([trees[s][0] for s in order]) if order else (None, [])
    for s, above in zip(order, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for before, after in path + above:
                node = sha("".join([*before, node, *after]))
            yield r[0], own, trees[s][0], root, sha("".join(x for b, a in path + above for x in b + a)), node, node == root


def of_manifest(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return counted(tuple(r) for r in manifest.manifest(df, tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).collect())


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(docs, levels, monkeypatch):  # noqa: F811
    monkeypatch.setattr(manifest, "LEVELS", levels)
    df, rows = docs
    if len(rows[0]) == 5:  # real rows: columns by name
        names = df.columns
        rows = [tuple(r[names.index(c)] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows]
    assert of_manifest(df) == counted(brute_manifest(rows))


def test_manifest_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    sizes = {None: 1, "": 17, "A": 16, "a": 300, "b": 1, "é": 33, "ﬀ": 2, "𝔘": 5, **{f"t{k}": 1 for k in range(20)}}
    rows = [(10_000_000_000_000_000 + k if k % 9 else None, f"Text {s} {k % 4}", "en", s, k, None, None, None) for s, n in sizes.items() for k in range(n)]
    assert of_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)) == counted(brute_manifest(rows))


def test_manifest_of_nothing_and_without_changes(spark, empty):  # noqa: F811
    assert manifest.manifest(empty).collect() == []
    one = manifest.manifest(spark.createDataFrame([(1, None, None, None, None, None, None, None)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root == hashlib.sha256(b"1:1----").hexdigest() and one[0].verified


def test_names_with_marks_and_in_capitals(spark):
    """Hyphens, apostrophes and possessives, a name in capitals, one that is a common word, and names that overlap."""
    texts = ["I met Prof. Jean-Luc Picard. Picard said that Jean-Luc Picard and JEAN-LUC PICARD left.", "Mrs O'Neil saw O'Neil; Mr Smith's dog bit Smith and SMITH, but a smith works.", "Mr John Smith, JOHN SMITH and John Smith Smith", "Ms A Baker Mr Baker baker Baker"]
    got = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for word in ("Picard", "PICARD", "Jean", "Luc", "Neil", "Smith", "John", "JOHN", "Baker"):
        assert not any(word in t for t in got), word
    # one word in capitals may be an acronym
    last = re.search(r"Mr (\w+)'s dog bit (\w+) and SMITH, but a smith works", got[1])
    assert last[1] == last[2] and re.fullmatch(r"Mr (\w+ \w+), [A-Z]+ [A-Z]+ and \1 \w+", got[2])
    first, name = re.search(r"Prof\. (\w+) (\w+)\.", got[0]).groups()
    assert got[0] == f"I met Prof. {first} {name}. {name} said that {first} {name} and {first.upper()} {name.upper()} left."
    assert got[3].startswith("Ms A ") and got[3].split()[3:] == ["Mr", got[3].split()[2], "baker", got[3].split()[2]]


def test_a_text_of_thousands_of_names(spark):
    names = [f"{a.upper()}{b}{c} {d.upper()}{a}x" for a in "abcdefgh" for b in "aeiou" for c in "klmnopqr" for d in "bcdfghjklmnp"]
    text = " said. ".join(f"Mr {n}" for n in names) + ". " + ". ".join(names)
    began = time.time()
    got = surrogates.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    words_ = got.text.split(". ")
    assert got.n_entities == 2 * len(names) and time.time() - began < 120
    assert [w.removeprefix("Mr ").removesuffix(" said") for w in words_[: len(names)]] == words_[len(names) :]

"""The operators against brute force, on real rows and on edge cases: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosieve.llm import exact_dedup, mixing, nearest, ngram_join, repeats, sharding, substring_dedup, suffix_dedup, surrogates, tokenize, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __sha string, text_key int, h int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def edge(spark):
    """Rows of every awkward kind, with extra columns whose names clash with inner ones."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rnd.choices(vocabulary, k=120)) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "two words", "Same Text", "same text", "SAME TEXT", "é É ä", base[0], base[0], base[0].upper()]
    texts += [base[k] + " tail " + str(k) for k in range(6)] + [" ".join(["x", *base[1].split()[1:]]), base[2][:700] + " " + base[3][:700]]
    texts += ["same text"] * 30 + [" ".join(rnd.choices(vocabulary, k=20_000)), "a" * 3000, "ab " * 900, "日本 語" * 200, "x\u0000y ▁ z"]
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, "clash", 1, 2) for k, t in enumerate(texts)]
    rows += [rows[9], rows[5], (None, "no id", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.fixture(scope="module")
def real(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [tuple(r[c] for c in df.columns) for r in df.collect()]


@pytest.fixture(scope="module", params=["edge", "real"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(rows)


def test_exact_groups(docs):
    df, rows = docs
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(FOLD)].append(r[0])
    got = exact_dedup.exact_groups(df).collect()
    largest = lambda g: max((x for x in g if x is not None), default=None)
    want = [(r[0], largest(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [(r[1] or "").translate(FOLD)] for g in [groups[t]]]
    assert counted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == counted(want)
    assert counted(r.text_sha256 for r in got if r.kept) == counted({x[3]: 1 for x in want})
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def brute_repeats(sequences, window):
    seen = collections.Counter(tuple(s[k : k + window]) for s in sequences for k in range(len(s) - window + 1))
    for s in sequences:
        covered = [False] * len(s)
        for k in range(len(s) - window + 1):
            if seen[tuple(s[k : k + window])] > 1:
                covered[k : k + window] = [True] * window
        yield covered


@pytest.mark.parametrize("limits", [(8192, 1 << 19), (3, 3000)])
def test_repeated_words(docs, limits, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(repeats, "WIDE", limits[0]), monkeypatch.setattr(vectors, "SLICE", limits[1])
    seqs = [[w.encode() for w in words(r[1])] for r in rows]
    want = counted((r[0], len(s), sum(c), hashlib.sha256(b" ".join(w for w, x in zip(s, c, strict=True) if not x)).hexdigest()) for r, s, c in zip(rows, seqs, brute_repeats(seqs, 12), strict=True))
    got = substring_dedup.repeated_words(df, window=12, gram=4).collect()
    assert counted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("limits", [(8192, 1 << 19), (3, 3000)])
def test_repeated_bytes(docs, limits, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(repeats, "WIDE", limits[0]), monkeypatch.setattr(vectors, "SLICE", limits[1])
    seqs = [(r[1] or "").encode() for r in rows]
    want = counted(
        (r[0], len(s), sum(c), sum(x and not (k and c[k - 1]) for k, x in enumerate(c)), hashlib.sha256(bytes(b for b, x in zip(s, c, strict=True) if not x)).hexdigest())
        for r, s, c in zip(rows, seqs, brute_repeats(seqs, 60), strict=True)
    )
    got = suffix_dedup.repeated_bytes(df, window=60, gram=20).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_semi_join_instead_of_a_bitmap(real, monkeypatch):
    df, _ = real
    with_bitmap = sorted((r.doc_id, r.kept_sha256) for r in substring_dedup.repeated_words(df).collect())
    monkeypatch.setattr(repeats, "BITMAP_KEYS", 0)
    assert sorted((r.doc_id, r.kept_sha256) for r in substring_dedup.repeated_words(df).collect()) == with_bitmap
    ids = sorted((r.doc_id, r.component_id) for r in ngram_join.linked_documents(df).collect())
    monkeypatch.undo()
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.linked_documents(df).collect()) == ids


def test_run_index_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        t = np.array([rnd.choice([97, 98]) for _ in range(rnd.randint(1, 50))] + [256])
        n = len(t)
        order, _ = suffix_dedup.suffix_order(t)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), n)
        assert suffix_dedup.RunIndex(t).matching_statistics().tolist() == [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]


def brute_labels(rows, k, percent):
    """A number for each row, equal for rows of one component."""
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(FOLD))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute_components(rows, k, percent):
    label, members = brute_labels(rows, k, percent), collections.defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        members[c].append(r[0])
    smallest = {c: min((x for x in v if x is not None), default=None) for c, v in members.items()}
    size = lambda w: len({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}) if w else 0
    return counted((r[0], size(words((r[1] or "").translate(FOLD))), smallest[c]) for r, c in zip(rows, label, strict=True))


@pytest.mark.parametrize("cap,frequent,k,percent", [(256, 48, 3, 90), (2, 1, 5, 80)])
def test_linked_documents(docs, cap, frequent, k, percent, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(ngram_join, "CAP", cap), monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = ngram_join.linked_documents(df, k, percent).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, percent)


def test_one_of_each_keeps_columns(real):
    df, rows = real
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})


def test_mix_meets_targets(docs):
    df, rows = docs
    got = mixing.mix(df).collect()
    size = lambda t: len(words(t))
    assert counted((r.doc_id, r.size) for r in got) == counted((r[0], size(r[1])) for r in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(2 * total[s] for s in full)
        free = free - full if full else set()
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == total[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in rows if r[3] == s) / 2 + 1


def test_mixed_repeats_rows(real):
    df, _ = real
    want = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}
    out = mixing.mixed(df)
    assert out.columns == df.columns and counted(r.doc_id for r in out.collect()) == counted(want)


def test_codec_equals_the_library(docs):
    import sentencepiece

    _, rows = docs
    path = tokenize.default_model()
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), tokenize.Codec.from_file(path)
    rnd = random.Random(2)
    codec.encode("x")
    texts = [r[1] or "" for r in rows] + [" " * k + "a" + " " * (40 - k) for k in range(40)]
    texts += ["".join(rnd.choices(list("abcdeforth ▁\n\t\réü日😀‍.,'-0159ﬁ\x00") + ["the ", "ing", "  ", "tion"], k=rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rnd.choices(codec.pieces, k=rnd.randint(1, 6))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t)
        assert codec.encode(t) == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), repr(t[:80])
        assert codec.decode(ids) == sp.decode(ids)


def test_tokenized_rows(docs):
    df, rows = docs
    codec = tokenize.Codec.from_file(tokenize.default_model())
    got = tokenize.tokenized(df, codec, with_ids=True).collect()
    assert counted(r.doc_id for r in got) == counted(r[0] for r in rows)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded == codec.decode(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_shards_are_even_and_gapless(docs):
    df, rows = docs
    got = sharding.sharded(df, 7).collect()
    assert counted((r.doc_id, r.size) for r in got) == counted((r[0], len((r[1] or "").encode()) + 8) for r in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_keep_copies_together(spark):
    texts = [f"text {k % 40}" if k < 80 else f"own {k}" for k in range(400)]
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


@pytest.mark.parametrize("pairs,least", [(0, 8), (50, 9)])
def test_shards_gather_a_group_larger_than_a_shard(spark, pairs, least):
    # pairs that already sit in a shard keep their places, so the group may need one shard more
    texts = ["same"] * 800 + [f"pair {k % pairs}" for k in range(2 * pairs)] + [f"own {k}" for k in range(1600 - 2 * pairs)]
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    parts = collections.Counter(r.shard for r in got if r.doc_id < 800)
    assert len(parts) <= least and set(collections.Counter(r.shard for r in got).values()) == {100}


def brute_nearest(rows, queries, k=5):
    fine = {i: np.array(v, float) / np.abs(v).max() for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in fine:
            s = [(-float(fine[q] @ v / (np.linalg.norm(fine[q]) * np.linalg.norm(v))), i) for i, v in fine.items() if i != q]
            out[q] = [(i, -x) for x, i in sorted((round(x, 12), i) for x, i in s)[:k]]
    return out


def test_nearest(spark, sf):
    real = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:120]
    odd = [(900, None), (950, [0.0] * 64), (1000, [float("nan")] * 64), (1050, [None] * 64), (1100, [float("inf")] * 64), (1150, real[0][1]), (1151, real[0][1]), (1152, [1e-160 * x for x in real[0][1]]), (1200, [1e200 * x for x in real[1][1]])]
    rows = real + odd + [(2000 + k, real[5][1]) for k in range(30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, id string")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    assert got.keys() == want.keys()
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-11)
    assert [i for i, _ in got[2000]] == [5, 2001, 2002, 2003, 2004]


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(80, 8)))]
    near = [(i, (np.array(rows[0][1]) + 0.01 * rng.normal(size=8)).tolist()) for i in range(100, 110)]
    # ids twice and six times with one vector, a query's id with several near ones, a vector and its double under one id
    rows += near + near[:1] * 5 + near[1:4] * 2 + [(0, x) for _, x in near[6:]] + [(104, [2 * c for c in near[4][1]])] + rows[:1] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, df.where("vec_id in (50, 105)").union(spark.createDataFrame(rows[:1] * 2, df.schema))).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unique = sorted({(i, tuple(v)) for i, v in rows})
    for q, v in [(0, rows[0][1]), (50, rows[50][1]), (105, near[5][1])]:
        cosine = lambda x: float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x)))  # noqa: B023, E731
        want = sorted(((round(-cosine(x), 12), i) for i, x in unique if i != q))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want], atol=1e-11)


def test_tile_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 16)) * rng.choice([1e-3, 1, 50], size=(500, 1))
    ids = np.arange(500)
    got = collections.defaultdict(list)
    for q, i, s in nearest.tile(ids[:40], v[:40], ids, v, 5):
        got[q].append((i, s))
    want = brute_nearest(list(zip(ids.tolist(), v.tolist(), strict=True)), range(40))
    assert all({i for i, _ in got[q]} == {i for i, _ in want[q]} for q in range(40))


def test_toxicity_on_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet"), spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/labels.parquet")
    model = toxicity.learnt(docs, labels)
    own = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    got = toxicity.score_texts(own, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert sum(hits) / len(hits) > 0.85 and sum(false) / len(false) < 0.01


def plain_score(text, model):
    """The score of a text, window by window with zstandard alone: no memory, no shortcuts."""
    import zstandard

    def length(content, window):
        shape = zstandard.ZstdCompressionParameters.from_level(13, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=shape).compress(b"\n<of> ~" + window.encode() + b"\n<of> ~"))

    gains = []
    for run in (text or "").lower().split():
        word = run.strip(toxicity.EDGES)
        for w in [word] if 0 < len(word) <= 40 else [word[k : k + 16] for k in range(0, len(word) - 12, 4)] if word else []:
            gains.append(length(model.distance.contents[0], w) - length(model.distance.contents[1], w))
    n, top = len(gains), sorted([*gains, 0, 0, 0], reverse=True)[:3]
    x = [*top, 10 * sum(g for g in gains if g >= 3) / (n + 20), 10 * sum(g for g in gains if g >= 6) / (n + 20), np.log1p(n), top[0] * np.log1p(n), 1]
    mean, scale, weight = model.weights
    return 1 / (1 + np.exp(-sum((v - m) / s * w for v, m, s, w in zip(x, mean, scale, weight, strict=True))))


def test_toxicity_against_plain_compression(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8)))
    ordinary = [" ".join(word() for _ in range(40)) for _ in range(60)]
    toxic = [" ".join([*(word() for _ in range(40)), *rnd.sample(["vilenessy", "rottenous", "zounderly"], 2)]) for _ in range(30)]
    model = toxicity.fit([t.encode() for t in toxic], [t.encode() for t in ordinary])
    texts = [*toxic[:6], *ordinary[:6], "", None, "«Rottenous!» said ¿zounderly", "x" * 90 + "vilenessy" * 3, "日本語" * 30, "VILENESSY vilenessy"]
    got = {r.doc_id: r for r in toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(abs(got[k].score - plain_score(t, model)) < 1e-9 for k, t in enumerate(texts))
    assert [got[k].predicted for k in range(12)] == [1] * 6 + [0] * 6 and got[14].predicted == got[17].predicted == 1


def test_toxicity_edges(edge, empty):
    df, rows = edge
    for model in (toxicity.fit([], []), toxicity.fit([b"you idiot"] * 8, [b"fine day"] * 8)):
        got = toxicity.score_texts(df, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert toxicity.clean(df, model).columns == df.columns
        assert toxicity.score_texts(empty, model).count() == 0


PERSONAL = [
    "mail thanti.16@mail8.example.com or THANTI.16@MAIL8.EXAMPLE.COM",
    "ip 240.56.125.154, not 1.2.3 or 999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111, number 123456",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"',
    "Mrs. Anna Smith met Mr Bob; Госпожа Анна Иванова",
    "call +1 (017) 555-7713 or +1 017 555 7713",
    "plain words only", "", None,
]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def test_surrogates_keep_format_and_coreference(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(PERSONAL)], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in surrogates.replaced(df).collect()}
    assert [got[k].n_entities for k in range(9)] == [2, 1, 2, 1, 3, 2, 0, 0, 0]
    assert [got[k].text for k in (6, 7, 8)] == PERSONAL[6:]
    low, high = re.findall(r"\S+@\S+", got[0].text)
    assert low.upper() == high and low != "thanti.16@mail8.example.com" and low.endswith(".com")
    assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+, not 1\.2\.3 or 999\.1\.1\.1", got[1].text) and "240.56.125.154" not in got[1].text
    a, b = re.findall(r"4\d{3}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[2].text)
    assert a.replace(" ", "-") == b and luhn(re.sub(r"\D", "", a)) == 0 and a != "4111 1111 1111 1111" and got[2].text.endswith("number 123456")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[3].text) and got[3].text != PERSONAL[3]
    assert re.fullmatch(r"Mrs\. \w+a \w+ met Mr \w+n; Госпожа [А-Яа-я]+а [А-Яа-я]+", got[4].text)
    one, two = re.findall(r"\+1 [\d() -]+\d", got[5].text)
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)


def test_surrogates_stay_distinct(spark):
    # names with few forms collide on their first draw
    texts = [f"Mr {a}{b}{c}x" for a in "ABCDEFGHIJKL" for b in "aeiouy" for c in "bcdfghklmn"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = surrogates.entities(df)
    redrawn = surrogates.resolved(found)
    got = [r.text for r in surrogates.replaced(df).collect()]
    assert redrawn.count() > 0 and len(set(got)) == len(texts) and not set(got) & set(texts)


def test_surrogates_never_run_out(spark):
    # more names than three syllables can spell, more one-letter and one-mark local parts than one digit of the host tells apart
    names = ["Mr " + (a + b + c + d).capitalize() for a in "bcdfghklmn" for b in "aeiouywrst" for c in "bcdfghklmn" for d in "aeiouy"]
    mails = [f"a@host{k}.org" for k in range(400)] + [f"_@host{k}.org" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(names + mails)), "doc_id long, text string")
    got = [r.text for r in surrogates.replaced(df).collect()]
    assert len(names) > 16**3 and len(set(got)) == len(names + mails) and not set(got) & set(names + mails)
    assert all(re.fullmatch(r"Mr [A-Z][a-z]+n|[a-z_]@mail\d[0-9a-f]*\.example\.org", t) for t in got)


def test_surrogates_of_one_person(spark):
    texts = [
        "Mr. Bob Smith and Mr Bob Smith, then Bob Smith, MR SMITH? Smith and Bob; Smithson stays",
        "Dr Alice Jones met Prof. Alice Jones and Mrs Jones",
        "Mr BOB SMITH shouts", "Bob Smith without a title stays", "田中さん and 田中さん, السيد محمد and מר כהן",
    ]
    got = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first = re.fullmatch(r"Mr\. (\w+n) (\w+) and Mr (\w+) (\w+), then (\w+) (\w+), MR SMITH\? (\w+) and Bob; Smithson stays", got[0].text)
    one, two = first.group(1), first.group(2)
    assert first.groups() == (one, two, one, two, one, two, two) and got[0].n_entities == 4 and (one, two) != ("Bob", "Smith")
    second = re.fullmatch(r"Dr (\w+ \w+) met Prof\. (\w+ \w+) and Mrs (\w+a)", got[1].text)
    assert second.group(1) == second.group(2) != "Alice Jones"
    assert got[2].text == f"Mr {one.upper()} {two.upper()} shouts"
    assert got[3].text == texts[3] and not got[3].changed
    other = re.fullmatch(r"(\w+)さん and (\w+)さん, السيد (\w+) and מר (\w+)", got[4].text)
    assert other.group(1) == other.group(2) != "田中" and other.group(3) != "محمد" and other.group(4) != "כהן" and got[4].n_entities == 4


def test_surrogates_against_brute_force(spark):
    """Over a whole small corpus: one surrogate for each entity, different ones for different entities, and none that was there."""
    rnd = random.Random(6)
    pick = lambda *x: rnd.choice(x)
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    make = [
        lambda: f"{pick('a', 'bo', 'cy7')}@{pick('x', 'y')}{digits(1)}.{pick('org', 'com')}", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        lambda: ".".join(str(rnd.randint(1, 254)) for _ in range(4)), lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{pick('Mr', 'Mrs', 'Mr.', 'Dr')} {pick('Ann', 'Bea', 'Cid')} {pick('Ash', 'Birch', 'Cedar')}", lambda: "".join(rnd.choices("0123456789abcdef", k=40)),
    ]
    entities = [rnd.choice(make)() for _ in range(300)]
    rows = [(k, f"x {a} y {b} z") for k, (a, b) in enumerate(zip(entities, entities[::-1], strict=True))]
    became = {}
    for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        parts = re.fullmatch("x (.*) y (.*) z", r.text, re.S).groups()
        for e, new in zip(re.fullmatch("x (.*) y (.*) z", rows[r.doc_id][1]).groups(), parts, strict=True):
            became.setdefault(e.replace(".", "") if e[0] in "MD" else e, set()).add(new.replace(".", "") if e[0] in "MD" else new)
    assert all(len(v) == 1 for v in became.values())
    news = [next(iter(v)) for v in became.values()]
    assert len(set(news)) == len(became) and not set(news) & set(became)


def test_surrogates_edges(docs, empty):
    df, rows = docs
    got = surrogates.replaced(df).collect()
    assert counted(r.doc_id for r in got) == counted(r[0] for r in rows)
    assert counted((r.doc_id, r.text) for r in got if not r.changed) == counted((r[0], r[1]) for r in rows) - counted((r[0], r[1]) for r in rows if r[1] and re.search(r"@|\d{3}|\d\.\d", r[1]) and (r[0], r[1]) not in {(x.doc_id, x.text) for x in got})
    assert surrogates.replaced(empty).count() == 0


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
    assert suffix_dedup.repeated_bytes(empty).count() == 0 and substring_dedup.repeated_words(empty).count() == 0
    assert ngram_join.linked_documents(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0 and sharding.sharded(empty).count() == 0
    vectors_ = empty.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    assert nearest.nearest(vectors_, vectors_).count() == 0
    assert tokenize.tokenized(empty, tokenize.Codec.from_file(tokenize.default_model())).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count() > 0


def test_one_of_each_on_edges(edge):
    df, rows = edge
    kept = ngram_join.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    label, groups = [c for c in brute_labels(rows, 5, 80)], collections.defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        if words(r[1]):
            groups[c].append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()]
    # without words every pair of id and text stays
    want += [i for i, _ in {(r[0], r[1] or "") for r in rows if not words(r[1])}]
    assert counted(r.doc_id for r in kept.collect()) == counted(want)


def test_mixed_on_edges(edge):
    df, rows = edge
    same = ["doc_id", "source", "key"]
    want = mixing.decisions(df).groupBy(*same).agg(F.sum("copies").alias("n")).where("n > 0")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = out.groupBy("doc_id", "source", F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    assert counted(map(tuple, got.collect())) == counted(map(tuple, want.collect()))


def test_hot_groups_of_near_copies(spark):
    """Many copies that differ in one word, around two bases, and a chain of copies each like the one before."""
    rnd = random.Random(9)
    base = [[f"w{rnd.randint(0, 9999)}" for _ in range(60)] for _ in range(2)]
    rows = [(k, " ".join(f"x{k}" if j == rnd.randint(0, 59) else w for j, w in enumerate(base[k % 2]))) for k in range(150)]
    chain = [f"c{k}" for k in range(120)]
    rows += [(1000 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = counted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_documents(df, 3, 80).collect())
    assert got == brute_components(rows, 3, 80)


def test_parts_of_chains_of_leaders(spark):
    links = spark.createDataFrame([(b"e", b"d"), (b"d", b"c"), (b"c", b"b"), (b"b", b"a"), (b"x", b"w"), (b"y", b"w"), (b"y", b"x")], "u binary, v binary")
    got = [(bytes(r.node), bytes(r.root)) for r in ngram_join.parts_of(links).collect()]
    assert len(got) == len(dict(got)) == 8 and dict(got) == {b"e": b"c", b"d": b"b", b"c": b"a", b"b": b"a", b"a": b"a", b"x": b"w", b"y": b"w", b"w": b"w"}


def test_pipeline_stages_on_edges(spark, edge, empty, sf):
    import corpus_pipeline

    for df in (edge[0], empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == df.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize("name", ["op2_nearest", "op6_ngram_join", "op7_exact_dedup", "op8_suffix_dedup", "op10_substring_dedup"])
def test_oracles(spark, sf, name):
    import duckdb

    from chronosieve.llm import registry

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)

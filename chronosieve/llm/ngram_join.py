"""N-gram Jaccard self-join with a token-group matrix, and the components of its links.

A document is the set of its distinct word n-grams; two documents link when the
Jaccard similarity of their sets reaches a percentage. Equal sets are one from
the start. Then:

1. Tokens (n-grams, hashed to 64 bits) get one order for the whole corpus: rare
   before frequent, then by hash. A set's prefix is its first n - ceil(t*n) + l
   tokens: sets that are similar enough share at least l tokens of their prefixes
   (the smaller of their l, which is 1 plus some percent of n). Frequent tokens are
   counted over all documents, so a passage that many documents share leads to
   no comparisons as long as a document has rarer tokens.
2. Leaders. Sets that share min-hashes are likely similar, so each set is compared
   exactly with the least set of those that share at least AGREE of its LEADS
   min-hashes. Near copies of one text, however many, so become one linked part at a
   linear cost; nothing is decided against a set here.
3. Similar sets are partitioned into groups: a linked part, or the unlinked sets that
   share the min-hash most others have, in pieces of about CAP sets. The token-group matrix holds, in
   sparse form, which tokens are in the union of a group's prefixes, with the sizes
   of its sets.
4. A set queries the matrix with its prefix, but no group of its own part, and of two
   parts the smaller one asks. The overlap with a group's union and the group's sizes
   bound its similarity with all of them; only groups of which some set can reach the
   threshold are opened, its own among them if it is not linked yet.
5. In an opened group the union of the full sets bounds the overlap once more;
   what passes is compared exactly with the members, all at once. Groups that many
   sets ask are opened in several tasks.
   Links to members that are linked to each other already tell no more, so one
   link for each linked part of a group is returned: never all pairs.
6. Components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats, vectors as V
from .common import checkpointed, load, packed, shuffle_partitions

SHINGLE, PERCENT = 3, 90
#: Tokens in more prefixes than FREQUENT are ordered last, by how many; tasks know them by a table of 2**TABLE_BITS bytes.
FREQUENT, TABLE_BITS = 24, 23
#: Tokens that a task counts at once.
TOKENS = 1 << 19
#: Percent of its size by which a set's prefix is longer, and so many of its tokens must be shared.
LONGER = 3
#: Sets in a group, about, and sets that ask one opening of it.
CAP, ASKED = 256, 512
#: Edges of a partition while components are sought.
EDGES = 20_000
#: Min-hashes of a set, and how many of them it must share with a leader to be compared with it.
LEADS, AGREE = 4, 2


class Sets:
    """Sets of all documents of a batch, slice by slice."""

    def __init__(self, shingle: int, percent: int, frequent=None):
        self.shingle, self.percent, self.frequent = shingle, percent, frequent

    def _word_hashes(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (first row, word hashes, offsets of the rows in them)."""
        for row, local, at in V.slices(offsets):
            if int(offsets[row + 1] - offsets[row]) <= V.SLICE:
                piece = V.FOLD[data[at : at + local[-1]]]
                starts, ends, rows = V.words(piece, local)
                yield row, V.word_hashes(piece, starts, ends), rows
            elif at == offsets[row]:  # a long text: its words piece by piece
                parts, begin, stop = [], at, int(offsets[row + 1])
                while begin < stop:
                    end = min(stop, begin + V.SLICE)
                    while end < stop and V.IS_WORD[data[end]]:
                        end += 1
                    piece = V.FOLD[data[begin:end]]
                    starts, ends, _ = V.words(piece, np.array([0, len(piece)]))
                    parts.append(V.word_hashes(piece, starts, ends))
                    begin = end
                words = np.concatenate(parts)
                yield row, words, np.array([0, len(words)])

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (first row, tokens, places of the rows in them): distinct tokens in the corpus' order."""
        k = self.shingle
        for row, words, rows in self._word_hashes(data, offsets):
            count = np.diff(rows)
            sums = V.prefix_sums(words, 3)
            many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
            owner = np.repeat(np.arange(len(count)), many)
            first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(rows[:-1], many)
            tokens = V.span(sums, first, np.minimum(first + k, rows[1:][owner]), 3)
            order = np.lexsort((tokens, owner))
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            tokens, owner = tokens[new], owner[new]
            if self.frequent is not None and len(tokens):
                level = self.frequent.value[_cell(_spread(tokens) >> 32)]
                if level.any():
                    order = np.lexsort((tokens, level, owner))
                    tokens = tokens[order]
            yield row, tokens, np.searchsorted(owner, np.arange(len(count) + 1))

    def prefix(self, places: np.ndarray, factor: int = 1) -> np.ndarray:
        """Which tokens belong to the prefixes, factor times as long as they must be."""
        n = np.diff(places)
        length = np.minimum(n, factor * (n - (self.percent * n + 99) // 100 + 1 + LONGER * n // 100))
        return np.arange(places[-1]) - np.repeat(places[:-1], n) < np.repeat(length, n)


def _spread(tokens: np.ndarray) -> np.ndarray:
    """Keys for tokens: prefixes hold small hashes by choice, keys are spread evenly."""
    return V.mixed(tokens + np.uint64(1)).view(np.int64)


def _cell(halves: np.ndarray) -> np.ndarray:
    """Where the table of frequent tokens has a key, by its upper half."""
    return (halves >> (32 - TABLE_BITS)) + (1 << (TABLE_BITS - 1))


def _counted(sets: Sets, factor: int, shift: int = 0):
    """Keys of the tokens in prefixes, without their lowest `shift` bits, with their number in the batch."""

    def run(batches):
        for batch in batches:
            got, size = [], 0
            for _, t, places in sets.of(*V.texts(batch)):
                got.append(t[sets.prefix(places, factor)])
                size += len(got[-1])
                if size > TOKENS:
                    yield told(got)
                    got, size = [], 0
            if got:
                yield told(got)

    def told(got):
        key, n = np.unique(_spread(np.concatenate(got)) >> shift, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["anchor", "n"])

    return run


def _sketches(sets: Sets, test):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("least", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for row, tokens, places in sets.of(*V.texts(batch)):
                n = np.diff(places)
                full = np.flatnonzero(n)
                node, least = [None] * len(n), np.zeros((len(n), LEADS), np.uint64)
                if len(full):
                    sums = np.stack([np.add.reduceat(V.mixed(tokens + np.uint64(c)), places[:-1][full]) for c in (3, 5)], 1)
                    for k, x in zip(full.tolist(), sums, strict=True):
                        node[k] = x.tobytes()
                    for r in range(LEADS):
                        least[full, r] = np.minimum.reduceat(V.mixed(tokens + np.uint64(101 + r)), places[:-1][full])
                keep = sets.prefix(places) & repeats._wanted(_spread(tokens), test)
                held = np.concatenate([[0], np.cumsum(keep)])[places].astype(np.int32)
                some = slice(row, row + len(n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[some], batch.column("text_key")[some], pa.array(n), pa.array(node, pa.binary()), pa.ListArray.from_arrays(np.arange(0, LEADS * len(n) + 1, LEADS, dtype=np.int32), pa.array(least.view(np.int64).ravel())), pa.ListArray.from_arrays(held, pa.array(_spread(tokens[keep])))], schema=schema)

    return run


def _opened(sets: Sets):
    """Links found in opened groups. Rows come sorted by group, members first; queries stream by."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    class Group:
        def __init__(self):
            self.nodes, self.tokens = [], []

        def close(self):
            """From here on only queries follow; gives the links between the members."""
            self.size = np.array([len(t) for t in self.tokens], np.int64)
            flat = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.nodes)), self.size)[order]
            self.part = np.arange(len(self.nodes))
            links = []
            for k, t in enumerate(self.tokens):
                for j in self.linked(t):
                    if self.part[j] != self.part[k]:
                        self.part[self.part == self.part[k]] = self.part[j]
                        links.append((self.nodes[k], self.nodes[int(j)]))
            self.tokens = None
            return links

        def linked(self, t):
            """One member of each linked part of the group that the set t links to."""
            a, b = np.searchsorted(self.flat, t, "left"), np.searchsorted(self.flat, t, "right")
            hit = b > a
            if 100 * int(hit.sum()) < sets.percent * len(t):  # the bound by the union
                return []
            a, n = a[hit], (b - a)[hit]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            both = np.bincount(self.owner[at], minlength=len(self.nodes))
            good = np.flatnonzero((100 * both >= sets.percent * (len(t) + self.size - both)) & (both > 0))
            _, first = np.unique(self.part[good], return_index=True)
            return good[first]

    def run(batches):
        gid, group, closed, out = None, None, False, []
        for batch in batches:
            each = (t[places[k] : places[k + 1]] for _, t, places in sets.of(*V.texts(batch)) for k in range(len(places) - 1))
            for g, role, node, own in zip(*(batch.column(c).to_pylist() for c in ("gid", "role", "node")), each, strict=True):
                if g != gid:
                    if group and not closed:
                        out += group.close()
                    gid, group, closed = g, Group(), False
                tokens = np.sort(own)
                if role == 0:
                    if not group.nodes or group.nodes[-1] != node:
                        group.nodes.append(node), group.tokens.append(tokens)
                    continue
                if not closed:
                    out += group.close()
                    closed = True
                out += [(node, group.nodes[int(j)]) for j in group.linked(tokens) if group.nodes[int(j)] != node]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], schema=schema)
                out = []
        if group and not closed:
            out = group.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): root is the smallest node that is reachable, for all nodes of the edges."""
    u, v = F.col("u"), F.col("v")
    edges = checkpointed(edges.where("u != v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(edges)
    while before[0]:
        # edges only become fewer, and so do the files that a round writes
        parts = -(-before[0] // EDGES)
        few = edges.coalesce(parts)
        both = few.unionByName(few.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(v.alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = mark(edges)
        if tuple(now) == tuple(before):
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(u.alias("node"), "root")
    return roots.unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())


def _frequent(counts: DataFrame):
    """The table of frequent tokens: bits of the count of the most frequent token of a cell, 0 where there is none."""
    cell = F.shiftright("anchor", 32 - TABLE_BITS) + (1 << (TABLE_BITS - 1))
    often = counts.where(F.col("n") > FREQUENT).groupBy(cell.cast("int").alias("cell")).agg(F.max("n").alias("n"))
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    for batch in often.select("cell", F.length(F.bin("n")).cast("byte").alias("level")).toArrow().to_batches():  # one row a cell at most
        table[batch.column("cell").to_numpy()] = batch.column("level").to_numpy()
    return counts.sparkSession.sparkContext.broadcast(table)


def compared(rows: DataFrame, members: DataFrame, asking: DataFrame, shingle: int, percent: int) -> DataFrame:
    """members, asking: gid, node, rep -> links (u, v) found in the opened groups, each in as many tasks as those that ask it need."""
    spark = rows.sparkSession
    openings = checkpointed(asking.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    asking = asking.join(openings, "gid").select("gid", part.alias("part"), F.lit(1).alias("role"), "node", "rep")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    members = members.join(openings, "gid", "left").select("gid", every.alias("part"), F.lit(0).alias("role"), "node", "rep")
    wanted = checkpointed(members.unionByName(asking).select(F.xxhash64("gid", "part").alias("gid"), "role", "node", F.col("rep.doc_id").alias("__id"), F.col("rep.text_key").alias("__key")))
    some = repeats.rows_in(rows, "text_key", repeats.bitmap(wanted.select(F.col("__key").alias("anchor")).distinct()))
    sent = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).select("gid", "role", "node", "text")
    return sent.repartition(shuffle_partitions(spark), "gid").sortWithinPartitions("gid", "role", "node").mapInArrow(_opened(Sets(shingle, percent)), "u binary, v binary")


def led(rows: DataFrame, unique: DataFrame, shingle: int, percent: int):
    """Verified links (u, v) between sets and their leaders, and the min-hash of each set that most others share: node, base."""
    keys = unique.select("node", "n", "rep", F.posexplode("least").alias("r", "h")).select("node", "n", "rep", F.xxhash64("r", "h").alias("key"))
    least = checkpointed(keys.groupBy("key").agg(F.min(F.struct("node", "n", "rep")).alias("lead"), F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    # LEADS leaders of a set at most
    own = keys.join(least, "key").groupBy("node").agg(F.first("n").alias("n"), F.first("rep").alias("rep"), F.collect_list("lead").alias("leads"), F.max(F.struct("sets", "key"))["key"].alias("base"))
    own = checkpointed(own)
    leads = F.filter(F.array_distinct("leads"), lambda x: F.size(F.filter("leads", lambda y: y["node"] == x["node"])) >= AGREE)
    fits = (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")) & (F.col("node") != F.col("lead.node"))
    pairs = own.select("node", "n", "rep", F.explode(leads).alias("lead")).where(fits).withColumn("gid", F.xxhash64("lead.node"))
    leaders = pairs.select("gid", "lead.node", "lead.rep").distinct()
    return compared(rows, leaders, pairs.select("gid", "node", "rep"), shingle, percent), own.select("node", "base")


def parts_of(links: DataFrame) -> DataFrame:
    """links (u, v) to leaders, v < u -> (node, root), one row a node: the least leader's own least leader; linked parts, if not always whole ones."""
    least = checkpointed(links.groupBy("u").agg(F.min("v").alias("v")))
    up = least.select(F.col("u").alias("v"), F.col("v").alias("top"))
    followers = checkpointed(least.join(up, "v", "left").select(F.col("u").alias("node"), F.coalesce("top", "v").alias("root")))
    # a root may follow another one further up; then it is in that one's part
    heads = followers.select(F.col("root").alias("node"), "root").distinct().join(followers.select("node"), "node", "left_anti")
    return followers.unionByName(heads)


def similar_sets(rows: DataFrame, shingle: int, percent: int):
    """rows: doc_id, text_key, text -> (sketches of all rows, links between different sets, roots of the parts that leaders link)."""
    texts = rows.select("text")

    # frequent tokens, counted in prefixes twice as long, as others move up when they step back;
    # half a key will do, as this only orders tokens
    frequent = _frequent(texts.mapInArrow(_counted(Sets(shingle, percent), 2, 32), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    sets = Sets(shingle, percent, frequent)
    shared, test = repeats.shared_keys(texts.mapInArrow(_counted(sets, 1), "anchor long, n long"))
    sketch = checkpointed(rows.mapInArrow(_sketches(sets, test), "doc_id long, text_key long, n long, node binary, least array<long>, tokens array<long>"))

    unique = sketch.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("tokens").alias("tokens"))
    unique = checkpointed(unique.where(F.size("tokens") > 0))
    links, popular = led(rows, unique, shingle, percent)
    roots = checkpointed(parts_of(links))
    base = F.when(F.col("root").isNotNull(), F.xxhash64("root")).otherwise(F.coalesce("base", F.xxhash64("node")))
    unique = unique.join(roots, "node", "left").join(popular, "node", "left").withColumn("base", base)
    # groups of at most about CAP sets of one linked part (size: its sets) or of one min-hash (size: 0)
    per = checkpointed(unique.groupBy("base", F.col("root").isNotNull().alias("linked")).agg(F.count(F.lit(1)).alias("sets")))
    same = (F.col("u.base") == F.col("p.base")) & (F.col("u.root").isNotNull() == F.col("p.linked"))
    gid = F.xxhash64("u.base", "linked", F.pmod(F.xxhash64("node"), F.ceil(F.col("p.sets") / CAP)))
    unique = unique.alias("u").join(per.alias("p"), same).select("node", "rep", "n", "tokens", gid.alias("gid"), F.when(F.col("linked"), F.col("p.sets")).otherwise(0).alias("size"), F.when(F.col("linked"), F.col("u.base")).alias("part"))
    unique = checkpointed(unique.withColumn("part", F.coalesce("part", "gid")))
    # candidates go by half a node: should two ever share it, both are looked at
    short = F.xxhash64("node").alias("nid")
    cells = unique.select(short, F.col("n").cast("int").alias("n"), "gid", "size", "part", F.explode("tokens").alias("token"))
    if test is None:
        cells = cells.join(shared.select(F.col("anchor").alias("token")), "token", "left_semi")
    matrix = cells.groupBy("token", "gid", "size", "part").agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("sets"))
    matrix = checkpointed(matrix.withColumn("order", F.struct("size", "part")))
    # what a token's sets may ask: parts above their own, or their own group if it is not linked; the top part asks nothing
    top = matrix.groupBy("token").agg(F.max("order").alias("top"), F.min("order").alias("low"), F.max(F.when(F.col("size") == 0, F.col("sets"))).alias("inner"))
    top = checkpointed(top.where("low < top or inner > 1").select("token", "top", F.coalesce("inner", F.lit(0)).alias("inner")))
    asks = cells.join(top, "token").where((F.struct("size", "part") < F.col("top")) | ((F.col("size") == 0) & (F.col("inner") > 1)))
    fits = (100 * F.col("largest") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("smallest"))
    # tokens of the set alone say nothing about its own group
    sides = (F.struct("q.size", "q.part") < F.col("order")) | ((F.col("q.size") == 0) & (F.col("q.gid") == F.col("m.gid")) & (F.col("sets") > 1))
    met = asks.alias("q").join(matrix.alias("m"), (F.col("q.token") == F.col("m.token")) & fits & sides)
    met = met.groupBy("nid", F.col("q.gid").alias("own"), F.col("m.gid").alias("gid"), "n").agg(F.count(F.lit(1)).alias("shared"), F.min("smallest").alias("smallest"))
    queries = checkpointed(met.where(F.col("shared") > F.floor(LONGER * F.least("n", "smallest") / 100)).select("nid", "own", "gid"))
    inner = queries.where("own = gid").select("nid", "gid")
    asking = queries.where("own != gid").select("nid", "gid")
    asked = unique.join(asking.select("gid").distinct(), "gid", "left_semi").select(short, "gid")
    named = unique.select(short, "node", "rep")
    members = inner.unionByName(asked).distinct().join(named, "nid").select("gid", "node", "rep")
    links = compared(rows, members, asking.join(named, "nid").select("gid", "node", "rep"), shingle, percent)
    return sketch, links, roots


def labelled(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, root (null without words) of every row."""
    rows = repeats.keyed(docs, id_col, text_col)
    sketch, links, roots = similar_sets(rows, shingle, percent)
    # links between parts, a part standing for its sets
    for side in ("u", "v"):
        part = roots.select(F.col("node").alias(side), F.col("root").alias("__root"))
        links = links.join(part, side, "left").withColumn(side, F.coalesce("__root", side)).drop("__root")
    # a part whose root is in another part belongs to it
    above = roots.where("node != root").join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("u"), F.col("root").alias("v"))
    whole = components(links.select("u", "v").unionByName(above)).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    own = sketch.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    own = own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("part"), "first_id")
    own = own.join(whole, "part", "left").select("node", F.coalesce("whole", "part").alias("root"), "first_id")
    ids = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpointed(own.join(ids, "root").select("node", "root", "component_id"))
    some = sketch.where("n > 0").select("doc_id", "text_key", "n", "node").join(named, "node").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root")
    return some.unionByName(sketch.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root")))


def linked_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of each document.

    Returns a row for every row of `docs`: doc_id, n_shingles, component_id. Words
    are compared with A-Z lower-cased; a text of fewer words than `shingle` is one
    token of all its words; a null text or one without words has no set, is linked
    with nothing and has its own id as component. Null ids take part in links but
    are never a component's id unless it has no other. Repeated rows have equal
    sets and so are linked. An empty table gives an empty result; other columns
    are ignored whatever their names.
    """
    return labelled(docs, shingle, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay when one document of each component does.

    It is the one with the smallest id (rows without id come last, ties by a hash
    of the text). Documents without words stay. Rows that repeat id and text are one
    document. An empty table gives an empty result; clashing column names stay apart.
    """
    rows = labelled(docs, shingle, percent, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("first")
    stay = rows.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.text_key").unionByName(rows.where("root is null").select("doc_id", "text_key"))
    stay = stay.select(F.struct("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = packed(docs, __id=F.struct(F.col("doc_id").cast("long").alias("doc_id")), __key=F.xxhash64(text))
    one = Window.partitionBy("__id", "__key").orderBy(F.lit(1))
    return full.join(stay, ["__id", "__key"], "left_semi").withColumn("__one", F.row_number().over(one)).where("__one = 1").select("__row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return linked_documents(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) c ON c.x = w.doc_id
"""

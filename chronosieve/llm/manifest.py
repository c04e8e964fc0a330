"""A Merkle manifest of a dataset with a proof for each row, by cogrouped subtree exchange.

Rows are leaves; a source's leaves, by id, form a tree of FAN children a node, and the
sources' roots form one more such tree. Rows are laid out by range partitions of (source,
id), so a row's place in its source comes from counts of the partitions' segments and no
source is one task's work. Then:

1. A superblock is FAN**LEVELS consecutive leaves of a source. Its leaves reduce locally to
   one node.
2. These outer nodes, one for thousands of leaves, reduce level by level to the
   sources' roots, and those to the root.
3. From the root down, each node hands its path (the siblings of all its ancestors) to its
   at most FAN children, until every superblock has the outer nodes that its proofs need.
4. Leaves and required outer nodes are cogrouped by superblock. One function finishes
   the local reduction, joins inner and outer siblings to proofs, and folds what a leaf has
   become up to the root. Small superblocks share a group, so that many small sources
   do not make many small groups.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, load, shuffle_partitions

FAN, LEVELS = 16, 3
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
OUT = "name string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of the parts' hex texts, one after another."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def encoded(columns: list[Column]) -> Column:
    """Each value as its length in bytes, a colon and its text; '-' for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def node_of(children: Column) -> Column:
    """The digest (binary) of an array of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(children, lambda x: F.lower(F.hex(x))), ""), 256))


def laid_out(leaves: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame]:
    """leaves with source -> (rows in range partitions by source and order, checkpointed; segments: a row for each partition and source in it)."""
    n = shuffle_partitions(leaves.sparkSession)
    nth = F.monotonically_increasing_id()
    by = [F.col("source").asc_nulls_first(), *order]
    rows = checkpointed(leaves.repartitionByRange(n, *by).sortWithinPartitions(*by).select("*", F.shiftright(nth, 33).alias("__part"), nth.alias("__nth")))
    return rows, rows.groupBy("__part", "source").agg(F.min("__nth").alias("__first"), F.count(F.lit(1)).alias("__rows"))


def located(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows with `at`, the place in their source's order from 0, and what else the segments say; a source has one segment a partition at most."""
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = segments.withColumn("__before", before).drop("__rows").withColumnsRenamed({"__part": "__p", "source": "__s"})
    both = rows.join(segments, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s")))
    return both.withColumn("at", F.col("__nth") - F.col("__first") + F.col("__before")).drop("__part", "__nth", "__p", "__s", "__first", "__before")


def runs_of(nodes: DataFrame) -> DataFrame:
    """tree, at, node -> tree, up (the parent's place), node (the parent's digest), children (digests, in order)."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
    runs = nodes.groupBy("tree", F.shiftright("at", FAN.bit_length() - 1).alias("up")).agg(children.alias("children"))
    return runs.withColumn("node", node_of(F.col("children")))


def reduced(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, at, node -> (tree, node: the roots of all trees; the runs of each level). A tree of one node is its own root."""
    levels, done = [], []
    while True:
        sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("tree")
        if sizes.isEmpty():
            done.append(nodes.select("tree", "node"))
            break
        done.append(nodes.join(sizes, "tree", "left_anti").select("tree", "node"))
        runs = checkpointed(runs_of(nodes.join(sizes, "tree", "left_semi")))
        levels.append(runs)
        nodes = runs.select("tree", F.col("up").alias("at"), "node")
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return checkpointed(roots), levels


#: A step of a path: the place among the children of the run, and all of them.
STEP = "array<struct<nth: int, children: array<binary>>>"


def paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, at, node of the lowest level; above: tree, path of the roots -> tree, at, node, path (upwards, to what is above).

    Each level hands its paths to the level below; a node has FAN children at most.
    """
    down = above.select("tree", F.lit(0).cast("long").alias("at"), "path")
    for runs in reversed(levels):
        parents = down.select("tree", F.col("at").alias("up"), F.col("path").alias("__above"))
        some = runs.join(parents, ["tree", "up"]).select("tree", "up", "children", "__above", F.posexplode(F.transform("children", lambda x: F.lit(0))).alias("nth", "__zero"))
        step = F.array(F.struct("nth", "children"))
        handed = some.select("tree", (F.col("up") * FAN + F.col("nth")).alias("at"), F.concat(step, "__above").cast(STEP).alias("path"))
        # trees without this level keep the path of their root
        rest = down.join(runs.select("tree").distinct(), "tree", "left_anti")
        down = handed.unionByName(rest)
    return nodes.join(checkpointed(down), ["tree", "at"])


def local_levels(leaves: list[bytes], count: int, most: int) -> list[list[bytes]]:
    """The nodes of a superblock, level by level, from its leaves up to one node.

    These are all levels of a source of `count` leaves, but `most` in a larger one.
    """
    out = [leaves]
    while count > 1 and len(out) <= most:
        low, count = out[-1], -(-count // FAN)
        out.append([digest(low[k : k + FAN]) for k in range(0, len(low), FAN)])
    return out


def _tops(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The node of each superblock of a group."""
    out = []
    for (tree, at), some in rows.groupby(["tree", "block"]):
        own = some.sort_values("at")
        out.append((tree, at, local_levels(own["leaf"].tolist(), int(own["count"].iloc[0]), most)[-1][0]))
    return pd.DataFrame(out, columns=["tree", "at", "node"])


def _proved(leaves: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """Proofs and folds of a group's leaves: inner levels first, then the path of their superblock."""
    paths_of = {(r.tree, r.at): r for r in outer.itertuples()}
    out = []
    for (tree, block), some in leaves.groupby(["tree", "block"]):
        own, top = some.sort_values("at"), paths_of[(tree, block)]
        inner = local_levels(own["leaf"].tolist(), int(own["count"].iloc[0]), most)
        steps = [(int(s["nth"]), [bytes(x) for x in s["children"]]) for s in top.path]
        beyond = "".join(c.hex() for nth, children in steps for k, c in enumerate(children) if k != nth).encode()
        root = bytes(top.root)
        hexes = [[x.hex().encode() for x in level] for level in inner[:-1]]
        first = int(own["at"].iloc[0])
        for name, at, leaf, now in zip(own["name"].tolist(), own["at"].tolist(), own["leaf"], own["now"], strict=True):
            proof, node, place = hashlib.sha256(), now.hex().encode(), at - first
            for level in hexes:
                start = place - place % FAN
                before, after = b"".join(level[start:place]), b"".join(level[place + 1 : start + FAN])
                proof.update(before + after)
                node, place = hashlib.sha256(before + node + after).hexdigest().encode(), place // FAN
            proof.update(beyond)
            folded = bytes.fromhex(node.decode())
            for nth, children in steps:
                folded = digest([*children[:nth], folded, *children[nth + 1 :]])
            out.append((name, leaf.hex(), top.subroot.hex(), root.hex(), proof.hexdigest(), folded.hex(), folded == root))
    return pd.DataFrame(out, columns=["name", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, changed: Column | None = None, now: Column | None = None) -> DataFrame:
    """A row for every row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Where `changed` holds, the
    text has become `now` since; the fold starts from what the leaf is now, and
    `verified` says whether it still leads to the root. A null in any column has an
    encoding of its own; a null source is a source, the first one, and null ids come
    first in theirs. Rows that repeat an id are ordered by their leaves; equal rows take
    neighbouring places, in any order. Very long texts are digested in the JVM and not
    moved. An empty table gives an empty result; other columns are ignored whatever their names.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *COLUMNS[2:], *([changed.alias("__changed"), now.alias("__now")] if changed is not None else []))
    leaf = F.unhex(F.sha2(encoded([F.col(c) for c in COLUMNS]), 256))
    after = F.unhex(F.sha2(encoded([*[F.col(c) for c in COLUMNS[:-1]], F.col("__now")]), 256)) if changed is not None else leaf
    after = F.when(F.coalesce("__changed", F.lit(False)), after).otherwise(leaf) if changed is not None else leaf
    # equal rows differ by their place in the input, so that ranges can part them; which of them comes first tells nothing
    leaves = kept.select(F.col("doc_id").cast("string").alias("name"), "doc_id", "source", leaf.alias("leaf"), after.alias("now"), F.monotonically_increasing_id().alias("__salt"))
    rows, segments = laid_out(leaves, F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("__salt"))
    # the sources are placed as rows of one more source
    sources = segments.groupBy("source").agg(F.sum("__rows").alias("count"))
    sources = located(*laid_out(sources.select(F.lit(None).cast("string").alias("source"), F.col("source").alias("title"), "count"), F.col("title").asc_nulls_first()))
    sources = checkpointed(sources.select("title", F.col("at").alias("tree"), "count"))
    leaves = located(rows, segments.join(sources, F.col("source").eqNullSafe(F.col("title"))).drop("title"))
    most = LEVELS
    block = F.shiftright("at", most * (FAN.bit_length() - 1))
    leaves = leaves.select("name", "tree", "count", "at", block.alias("block"), "leaf", "now")
    total = sources.agg(F.sum("count")).first()[0] or 0
    groups = max(1, -(-total // FAN**most))
    group = lambda tree, at: F.pmod(F.xxhash64(tree, at), F.lit(groups)).alias("group")
    leaves = checkpointed(leaves.withColumn("group", group("tree", "block")))

    tops = checkpointed(leaves.select("group", "tree", "block", "count", "at", "leaf").groupBy("group").applyInPandas(lambda rows: _tops(rows, most), "tree long, at long, node binary"))
    subroots, levels = reduced(tops)
    root, upper = reduced(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "node"))
    ends = paths(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "node"), upper, root.select("tree", F.array().cast(STEP).alias("path")))
    ends = ends.join(F.broadcast(root.select("tree", F.col("node").alias("root"))), "tree")  # one row
    ends = checkpointed(ends.select(F.col("at").alias("tree"), F.col("node").alias("subroot"), "root", "path"))
    outer = paths(tops, levels, ends.select("tree", "path")).join(ends.select("tree", "subroot", "root"), "tree")
    outer = outer.select(group("tree", "at"), "tree", "at", "subroot", "root", "path")
    proved = leaves.groupBy("group").cogroup(outer.groupBy("group")).applyInPandas(lambda rows, nodes: _proved(rows, nodes, most), OUT)
    # ids go through pandas as text: beside a null, numbers would become doubles there
    return proved.select(F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, ascii_lower(F.col("text")))


#: Levels of a tree that the statement has: enough for 16**7 leaves of a source.
DEEP = 7


def _oracle() -> str:
    enc = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    head = " || ".join(enc(x) for x in COLUMNS[:-1])
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    digits = "list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT))"
    steps = [
        f"d AS (SELECT doc_id, source, sha256({head} || {enc('text')}) AS leaf, CASE WHEN xor(list_reduce({digits}, lambda a, b: {bits}), 4294967295) % 5 = 0 THEN sha256({head} || {enc(low)}) ELSE sha256({head} || {enc('text')}) END AS now FROM documents)",
        "l0 AS (SELECT doc_id, coalesce('s' || source, '') AS tree, leaf, now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "n0 AS (SELECT tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS size FROM l0)",
    ]

    def tree(n: str, r: str) -> None:
        """The runs of each level, as lists, and the nodes above them."""
        for k in range(DEEP):
            steps.append(f"{r}{k} AS (SELECT tree, pos // 16 AS up, list(node ORDER BY pos) AS kids FROM {n}{k} WHERE size > 1 GROUP BY ALL)")
            steps.append(f"{n}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM (SELECT tree, up AS pos, sha256(array_to_string(kids, '')) AS node FROM {r}{k} UNION ALL SELECT tree, pos, node FROM {n}{k} WHERE size = 1))")

    def climb(last: str, r: str, name: str) -> str:
        """Each row's siblings and fold, level by level."""
        before, after = "coalesce(array_to_string(kids[:x.pos % 16], ''), '')", "coalesce(array_to_string(kids[x.pos % 16 + 2:], ''), '')"
        for k in range(DEEP):
            fold = f"CASE WHEN kids IS NULL THEN now ELSE sha256({before} || now || {after}) END"
            steps.append(f"{name}{k} AS (SELECT x.* EXCLUDE (pos, proof, now), coalesce(up, x.pos) AS pos, proof || {before} || {after} AS proof, {fold} AS now FROM {last} x LEFT JOIN {r}{k} y ON y.tree = x.tree AND up = x.pos // 16)")
            last = f"{name}{k}"
        return last

    tree("n", "r")
    steps.append(f"s AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM n{DEEP})")
    steps.append("m0 AS (SELECT 0 AS tree, pos, subroot AS node, count(*) OVER () AS size FROM s)")
    tree("m", "q")
    steps.append("a AS (SELECT doc_id, tree, leaf, pos, '' AS proof, now FROM l0)")
    steps.append(f"e AS (SELECT doc_id, leaf, subroot, 0 AS tree, s.pos, proof, now FROM {climb('a', 'r', 'b')} x JOIN s ON s.source = x.tree)")
    last = climb("e", "q", "c")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = node AS verified FROM {last} JOIN m{DEEP} USING (tree)"


ORACLE = _oracle()

"""Nearest controls within a caliper, one treated row after another, without pairs of rows.

Treated rows choose in the order of p, so what they have taken so far has a simple shape.
Rows of one p are a point, with a number of treated rows and of places (controls times
their reuse), taken by smaller ids first. Right of the row that chooses, the taken places
are one run: a frontier says where the next free place is. Left of it, the free places
are a stack: the nearest one is on top, and passing a point pushes what it has left. So
one scan over the points in order finds all pairs.

The scan is cut into blocks of points. Over a seam goes the frontier, one number, and the
stack, by reference: how many free places are left of each block before. A block is given
no more of both than its treated rows can take: the top of the stack and the first places
behind its end. All blocks run at once, at first as if nothing came over their seams; those
that were told otherwise by their left neighbours run again, until none is. The first
block is right at once and each round makes one more right at least; where controls are
not exhausted over whole blocks, two or three rounds do. Rows and pairs stay on the
executors; the driver holds a few numbers for each block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .ranks import running

#: Points, and treated rows, of a block.
POINTS = 1 << 16
#: Pairs of a record before records are taken apart.
PIECE = 4096


def scanned(own: list[dict], left: list[dict], right: list[dict], frontier: int) -> tuple[list[tuple], list[list], int, int]:
    """One block: (takes, free places of its last group, frontier behind it, places taken from `left`).

    own, right: points in order with grp, p, nt, cap (places), u (places of all points before), at_t,
    at_c, low (smallest control), width; left: the stack, nearest last, with cap free
    places after `used` taken ones. A take: (first treated number, control number, place, how many).
    """
    stack = [[r["p"], r["cap"], r["used"], r["at_c"], r["low"], False] for r in left]
    places = [r for r in own + right if r["cap"]]
    takes, popped, at, grp = [], 0, 0, own[0]["grp"]
    for r in own:
        p, n, t = r["p"], r["nt"], r["at_t"]
        if r["grp"] != grp:
            grp, stack, frontier = r["grp"], [], max(frontier, r["u"])
        while n:
            while stack and not stack[-1][1]:
                stack.pop()
            while at < len(places) and places[at]["u"] + places[at]["cap"] <= frontier:
                at += 1
            ahead = places[at] if at < len(places) and places[at]["grp"] == grp else None
            best = None
            if stack:
                best = (p - stack[-1][0], stack[-1][4])
            if ahead is not None and (best is None or (ahead["p"] - p, ahead["low"]) < best):
                if ahead["p"] - p > r["width"]:
                    break
                begin = max(frontier, ahead["u"])
                k = min(n, ahead["u"] + ahead["cap"] - begin)
                takes.append((t, ahead["at_c"], begin - ahead["u"], k))
                frontier = begin + k
            else:
                if best is None or best[0] > r["width"]:
                    break
                top = stack[-1]
                k = min(n, top[1])
                takes.append((t, top[3], top[2], k))
                top[1], top[2] = top[1] - k, top[2] + k
                popped += 0 if top[5] else k
            n, t = n - k, t + k
        if r["cap"]:
            used = min(max(frontier - r["u"], 0), r["cap"])
            if used < r["cap"]:
                stack.append([p, r["cap"] - used, used, r["at_c"], r["low"], True])
            frontier = max(frontier, r["u"] + r["cap"])
    last = own[-1]
    free = [s for s in stack if s[5] and s[1] and last["p"] - s[0] <= last["width"]]
    return takes, free, frontier, popped


def _block(schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        sides: list[list[dict]] = [[], [], []]
        for r in rows.sort_by([("role", "ascending"), ("nth", "ascending")]).to_pylist():
            sides[r["role"]].append(r)
        own, left, right = sides
        takes, free, frontier, popped = scanned(own, left, right, own[0]["frontier"])
        none = dict.fromkeys(schema.names)
        block, grp = own[0]["block"], own[-1]["grp"]
        out = [none | {"kind": 0, "block": block, "t": t, "at_c": c, "used": place + k, "n": min(PIECE, n - k), "nth": t + k} for t, c, place, n in takes for k in range(0, n, PIECE)]
        low = 0
        for p, n, used, c, least, _ in free:
            out.append(none | {"kind": 1, "block": block, "grp": grp, "p": p, "at_c": c, "used": used, "low": least, "nth": low, "n": n})
            low += n
        out.append(none | {"kind": 2, "block": block, "t": frontier, "used": popped, "n": low})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def takes_of(points: DataFrame, blocks: list) -> DataFrame:
    """points: block, nth, grp, p, nt, cap, u, at_t, at_c, low, width; blocks: their ends, in order -> the takes of all blocks.

    The result: at_t (number of a treated row), at_c, place (a place of the control's point), n (so many more of both).
    """
    spark = points.sparkSession
    kind = dict(points.dtypes)["low"]
    out = f"kind int, block long, t long, at_c long, used long, n long, grp long, p double, low {kind}, nth long"
    schema = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}.get(t, pa.int64())) for c, t in (x.split() for x in out.split(", "))])
    index = {b.block: k for k, b in enumerate(blocks)}
    told: dict[int, tuple] = {}  # what a block was told when it ran
    said: dict[int, tuple] = {}  # and what it said: frontier, places taken from the left, places left free
    latest = None
    while True:
        now: dict[int, tuple] = {}
        frontier, stack = 0, []
        for k, b in enumerate(blocks):
            before = blocks[k - 1] if k else None
            if before is not None:
                gone, popped, free = said.get(before.block, (0, 0, 0))
                stack = [] if before.first_grp != before.last_grp else _popped(stack, popped)
                stack = [*stack, (before.block, free)] if free else stack
                frontier = gone
                if before.last_grp != b.first_grp:
                    stack = []
                stack = [s for s in stack if b.first_p - blocks[index[s[0]]].last_p <= b.width]
            now[b.block] = (max(frontier, b.first_u), tuple(_top(stack, b.nt)))
        changed = [b for b in blocks if now[b.block] != told.get(b.block)]
        if not changed:
            return latest.where("kind = 0").select(F.col("nth").alias("at_t"), "at_c", F.col("used").alias("place"), "n")
        told = now
        tops = [(b.block, j, lo, hi) for b in changed for j, lo, hi in now[b.block][1]]
        heads = []
        for b in changed:
            lo = max(b.last_u, now[b.block][0]) if b.first_grp == b.last_grp else b.last_u
            m = index[b.block] + 1
            while b.nt and m < len(blocks) and blocks[m].first_grp == b.last_grp and blocks[m].first_u < lo + b.nt and blocks[m].first_p - b.last_p <= b.width:
                heads.append((b.block, blocks[m].block, lo, lo + b.nt, b.last_grp))
                m += 1
        # a few rows for each block: they fit any task
        ran = F.broadcast(spark.createDataFrame([(b.block, now[b.block][0]) for b in changed], "block long, frontier long"))
        columns = ["block", "role", "nth", "frontier", "grp", "p", "nt", "cap", "u", "used", "at_t", "at_c", "low", "width"]
        zero = F.lit(0).cast("long")
        rows = points.join(ran, "block").withColumns({"role": F.lit(0), "used": zero}).select(columns)
        if tops:
            asked = F.broadcast(spark.createDataFrame(tops, "to long, block long, lo long, hi long"))
            end = F.least(F.col("nth") + F.col("n"), F.col("hi"))
            some = latest.where("kind = 1").join(asked, "block").where((F.col("nth") < F.col("hi")) & (F.col("nth") + F.col("n") > F.col("lo")))
            some = some.select(F.col("to").alias("block"), F.lit(1).alias("role"), (F.col("block") * F.lit(1 << 40) + F.col("nth")).alias("nth"), zero.alias("frontier"), "grp", "p", zero.alias("nt"), (end - F.greatest("nth", "lo")).alias("cap"), zero.alias("u"), (F.col("used") + F.col("nth") + F.col("n") - end).alias("used"), zero.alias("at_t"), "at_c", "low", F.lit(0.0).alias("width"))
            rows = rows.unionByName(some.select(columns))
        if heads:
            asked = F.broadcast(spark.createDataFrame(heads, "to long, block long, lo long, hi long, of long"))
            some = points.where("cap > 0").join(asked, "block").where((F.col("u") < F.col("hi")) & (F.col("u") + F.col("cap") > F.col("lo")) & (F.col("grp") == F.col("of")))
            rows = rows.unionByName(some.select(F.col("to").alias("block"), F.lit(2).alias("role"), "nth", zero.alias("frontier"), "grp", "p", "nt", "cap", "u", zero.alias("used"), "at_t", "at_c", "low", "width"))
        new = rows.groupBy("block").applyInArrow(_block(schema), out)
        if latest is not None:
            new = latest.join(ran.select("block"), "block", "left_anti").select(*schema.names).unionByName(new)
        latest = saved(new)
        said |= {r.block: (r.t, r.used, r.n) for r in latest.where("kind = 2").join(ran.select("block"), "block").collect()}  # a row for each block


def _popped(stack: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The stack without its n topmost places."""
    out = list(stack)
    while n and out:
        block, free = out.pop()
        if free > n:
            out.append((block, free - n))
        n = max(0, n - free)
    return out


def _top(stack: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """The n topmost places, as (block, from, to) from the bottom up."""
    out = []
    for block, free in reversed(stack):
        if not n:
            break
        out.append((block, max(0, free - n), free))
        n -= min(n, free)
    return out[::-1]


def nearest_controls(rows: DataFrame, group: list[str], ident: str, treated: str, p: str, width: DataFrame, reuse: int) -> DataFrame:
    """group, a_id, b_id, pa, pb, score: each treated row with its nearest control; width: group, __width.

    Treated rows (1) choose in the order of p, then id, the nearest control (0) within the width that
    has been chosen less than `reuse` times; of controls with one p the smaller id goes first, of two at
    equal distances on both sides that whose p has the smaller id. Rows without p or group take no part.
    """
    is_text = dict(rows.dtypes)[ident] == "string"
    data = rows.select(*group, F.col(ident).alias("__id"), F.col(treated).cast("int").alias("__t"), (F.col(p).cast("double") + F.lit(0.0)).alias("__p"))
    keep = F.col("__t").isin(0, 1) & F.col("__p").isNotNull() & ~F.isnan("__p") & F.col("__id").isNotNull()
    for c in group:
        keep = keep & F.col(c).isNotNull()
    ordered = saved(running(data.where(keep), [*map(F.col, group), F.col("__t"), F.col("__p"), F.col("__id")], {"__at": F.lit(1)}))
    of = lambda f, c, t: f(F.when(F.col("__t") == t, F.col(c)))
    points = ordered.groupBy(*group, "__p").agg(F.count_if(F.col("__t") == 1).alias("nt"), (F.count_if(F.col("__t") == 0) * reuse).alias("cap"), of(F.min, "__at", 1).alias("at_t"), of(F.min, "__at", 0).alias("at_c"), of(F.min, "__id", 0).alias("low"))
    points = points.join(width, group) if group else points.crossJoin(F.broadcast(width))  # one row without groups
    grp = F.xxhash64(*group) if group else F.lit(0).cast("long")
    # many treated rows at one p are several points, the controls with the first
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("nt") - 1) / POINTS))))
    cut = points.withColumn("piece", piece).withColumns({"grp": grp, "first": F.col("piece") == 0})
    cut = cut.select(*group, "grp", F.col("__p").alias("p"), "piece", F.greatest(F.lit(0), F.least(F.lit(POINTS), F.col("nt") - F.col("piece") * POINTS)).cast("long").alias("nt"), F.when(F.col("first"), F.col("cap")).otherwise(0).cast("long").alias("cap"), (F.coalesce("at_t", F.lit(0)) + F.col("piece") * POINTS).alias("at_t"), F.coalesce("at_c", F.lit(0)).alias("at_c"), F.coalesce("low", F.lit("" if is_text else 0).cast(dict(points.dtypes)["low"])).alias("low"), F.coalesce("__width", F.lit(0.0)).alias("width"))
    cut = running(cut, [*map(F.col, group), F.col("p"), F.col("piece")], {"nth": F.lit(1), "weight": F.col("nt") + 1, "u": F.col("cap")})
    cut = saved(cut.withColumn("block", F.floor(F.col("weight") / POINTS)).select("block", "nth", "grp", "p", "nt", "cap", "u", "at_t", "at_c", "low", "width"))
    ends = cut.groupBy("block").agg(
        F.min_by("grp", "nth").alias("first_grp"), F.max_by("grp", "nth").alias("last_grp"), F.min_by("p", "nth").alias("first_p"), F.max_by("p", "nth").alias("last_p"),
        F.sum("nt").alias("nt"), F.min("u").alias("first_u"), F.max(F.col("u") + F.col("cap")).alias("last_u"), F.max_by("width", "nth").alias("width"),
    )
    blocks = ends.orderBy("block").collect()  # a row for each block
    a_rows = ordered.select(*group, F.col("__at").alias("__ta"), F.col("__id").alias("a_id"), F.col("__p").alias("pa"))
    b_rows = ordered.select(F.col("__at").alias("__ca"), F.col("__id").alias("b_id"), F.col("__p").alias("pb"))
    if not blocks:
        return a_rows.join(b_rows, F.col("__ta") == F.col("__ca")).where("false").select(*group, "a_id", "b_id", "pa", "pb", F.col("pa").alias("score"))
    each = takes_of(cut, blocks).select("at_t", "at_c", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    each = each.select((F.col("at_t") + F.col("k")).alias("__ta"), (F.col("at_c") + F.floor((F.col("place") + F.col("k")) / reuse)).alias("__ca"))
    return each.join(a_rows, "__ta").join(b_rows, "__ca").select(*group, "a_id", "b_id", "pa", "pb", F.abs(F.col("pa") - F.col("pb")).alias("score"))

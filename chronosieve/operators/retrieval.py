"""Chunks of text and nearest chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_chunks(docs: DataFrame, ident: str, text: str, size: int = 600, stride: int = 480) -> DataFrame:
    """Chunks of `size` characters, each `stride` after the one before; the last holds the end of the text."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(float(stride))), F.lit(0)).cast("int"))
    c = docs.select(ident, F.col(text).alias("__t"), F.explode(starts).alias("k"))
    return c.select(ident, F.col("k").cast("long").alias("chunk"), F.expr(f"substring(__t, k * {stride} + 1, {size})").alias("body"))


def packed_chunks(docs: DataFrame, ident: str, text: str, size: int = 600, stride: int = 480) -> DataFrame:
    """Sections between blank lines packed in order into chunks.

    A section joins the open chunk while both together have at most `size`
    characters; a longer section is cut into windows of `size`, each `stride` after
    the one before, and the chunk before it is closed. Empty texts have no chunks.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    sections = F.filter(F.transform(F.split(strip(F.col(text)), r"\n\n+"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def windows(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / stride).cast("int")), lambda k: strip(F.substr(p, k * stride + 1, F.lit(size))))
        return F.filter(cut, lambda x: x != "")

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) <= size
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        long = F.length(p) > size
        return F.struct(
            F.when(fits, acc["done"]).when(long, F.concat(closed, windows(p))).otherwise(closed).alias("done"),
            F.when(fits, strip(F.concat(acc["open"], F.lit("\n\n"), p))).when(long, "").otherwise(p).alias("open"),
        )

    packed = F.aggregate(sections, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return docs.select(ident, F.posexplode(packed).alias("chunk", "body")).withColumn("chunk", F.col("chunk").cast("long"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine_topk(vectors: DataFrame, query: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """The k vectors nearest to one query vector (a one-row DataFrame with column `q`), by cosine, ties to smaller ids."""
    both = vectors.crossJoin(F.broadcast(query.limit(1)))  # one row on the right
    score = dot(F.col(vector), F.col("q")) / (F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    return both.select(ident, score.alias("score")).orderBy(F.desc("score"), ident).limit(k)

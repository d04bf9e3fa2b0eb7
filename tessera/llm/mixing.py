"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import arrow, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are broadcast; beyond it they are joined by a shuffle that AQE may split.
BROADCAST_SOURCES = 10_000
#: Cells of a source's ranking; only the documents of one cell are ever sorted together.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), the same for the same key on every run and engine: 52 bits of an md5 sum."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows up to each, in an order without ties: rows are dealt by range, and a range starts behind those before it."""
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    parts = dealt.groupBy("_p").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ahead = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = parts.select("_p", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = dealt.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()]).join(before, "_p")
    return own.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def source_targets(base: DataFrame, weights: tuple[int, ...], repeat: int) -> DataFrame:
    """One row a source: its size and its target, in words.

    Sources in code-point order, null last, take the weights in turn and share all words by them.
    A target stops at ``repeat`` times its source; what is over goes to the others by weight. With
    the sources ordered by cap / weight that is a water level: the highest share of one unit of
    weight that is not above the cap of the source at which it is computed. Both orders are in
    ranges, so sources may be as many as hosts.
    """
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("mass"))
    s = running_sums(sizes, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}).withColumn("turn", F.col("turn") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", (repeat * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = scratch.keep(running_sums(s, [F.col("ratio"), F.col("turn")], {"caps": F.col("cap"), "taken": F.col("weight")}), "levels")
    whole = s.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weights"))  # one row
    level = (F.col("words") - (F.col("caps") - F.col("cap"))) / (F.col("weights") - (F.col("taken") - F.col("weight")))
    top = s.crossJoin(F.broadcast(whole)).select(F.when(level <= F.col("ratio"), level).alias("level")).agg(F.max("level").alias("level"))
    s = s.crossJoin(F.broadcast(top))
    return s.select("source", "source_size", "mass", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def pareto_mix(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    importance_col: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    repeat: int = 3,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document; one row out for each row in.

    A document's expected copies are its source's target over its source's words (times its
    importance, if that is a column). The whole part is certain. The rest is its inclusion
    probability p in a Pareto order sample: documents rank by u / (1 - u) over p / (1 - p), u
    uniform by the document's id, and a source takes them in that order up to the count of words
    it still needs (the prefix nearest to it), so each source's words are fixed up to half a document.

    A source may hold any share of all rows: the prefix is found from a histogram of CELLS cells a
    source, and only the cell in which the need is met is sorted.

    Null and empty texts have no words, one of any length is counted whole, a null source is a source of its own, a null id draws as "". Documents
    without words draw no copy beyond the certain ones. Rows with the same id draw the same u and may be
    taken together. An empty table gives none. Only the named columns are read. Null importance is 0.

    Columns: doc_id, size, source_size, target, taken (words), copies, p, text_hash (see arrow.text_hash).
    """
    importance = F.coalesce(F.col(importance_col).cast("double"), F.lit(0.0)) if importance_col else F.lit(1.0)
    base = scratch.keep(
        documents.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            importance.alias("importance"), arrow.text_hash(F.col(text_col)).alias("text_hash"), uniform(F.col(id_col), seed).alias("u"),
        ),
        "mix",
    )
    targets = scratch.keep(source_targets(base, weights, repeat), "mix-targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else lambda df: df
    t = targets.withColumnRenamed("source", "of")
    d = base.join(hint(t), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.least(F.lit(float(repeat)), F.when(F.col("mass") > 0, F.col("target") / F.col("mass") * F.col("importance")).otherwise(0.0))
    d = d.withColumn("expected", copies).withColumn("sure", F.floor("expected")).withColumn("p", F.col("expected") - F.col("sure"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    d = d.withColumn("q", F.when(drawn, odds)).withColumn("cell", F.when(drawn, F.floor(F.col("q") / (1 + F.col("q")) * CELLS)))
    # words each source still needs, and the cell in which its ranking meets them
    cells = d.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.sum(F.col("sure") * F.col("size")).alias("sure_words"), F.max("target").alias("target"))
    of_source = W.partitionBy("source")
    cells = cells.withColumn("need", F.col("target") - F.sum("sure_words").over(of_source)).filter("cell IS NOT NULL")
    before = F.sum("words").over(of_source.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    cells = cells.withColumn("before", before)
    cut = cells.filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
    last = cells.groupBy("source").agg(F.max("cell").alias("cell"), F.max("need").alias("need"), F.sum("words").alias("all"))
    last = last.filter(F.col("all") < F.col("need")).select("source", (F.col("cell") + 1).alias("cut"), "need", F.lit(0).cast("long").alias("before"))
    cut = cut.select("source", F.col("cell").alias("cut"), "need", "before").unionByName(last)
    cut = cut.withColumnRenamed("source", "of")
    d = d.join(hint(cut), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    inside = d.filter(F.col("cell") == F.col("cut"))
    ranked = W.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("extra", (2 * (F.col("before") + F.sum("size").over(ranked)) - F.col("size") <= 2 * F.col("need")).cast("long"))
    rest = d.filter(~F.coalesce(F.col("cell") == F.col("cut"), F.lit(False)))
    rest = rest.withColumn("extra", F.coalesce((F.col("cell") < F.col("cut")).cast("long"), F.lit(0)))
    out = rest.unionByName(inside).withColumn("copies", F.col("sure") + F.col("extra"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "p", "text_hash")

"""Plots and pages as text: SVG and HTML of a cluster, made where its rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a step and height of a plot, and colours of the bases (A, C, G, T).
STEP, HEIGHT = 10, 100
COLOURS = {"A": "green", "C": "blue", "G": "orange", "T": "red"}


def escaped(c: Column) -> Column:
    out = c.cast("string")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _svg(width: Column, body: Column) -> Column:
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), width.cast("string"), F.lit(f'" height="{HEIGHT}">'), body, F.lit("</svg>"))


def expression_svg(expressions: DataFrame) -> DataFrame:
    """(cluster, svg): a line for each gene over the conditions, the cluster's own first, scaled to the cluster's range."""
    ends = expressions.groupBy("cluster").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    d = expressions.join(ends, "cluster")
    y = F.when(F.col("_b") > F.col("_a"), F.round(HEIGHT * (F.col("_b") - F.col("value")) / (F.col("_b") - F.col("_a"))).cast("long")).otherwise(0)
    d = d.select("cluster", "gene", F.struct((~F.col("in_cluster")).alias("out"), "cond", y.alias("y")).alias("p"))
    lines = d.groupBy("cluster", "gene").agg(F.sort_array(F.collect_list("p")).alias("p"))
    points = F.array_join(F.transform("p", lambda x, i: F.concat((i * STEP).cast("string"), F.lit(","), x["y"].cast("string"))), " ")
    line = F.concat(F.lit('<polyline fill="none" stroke="gray" points="'), points, F.lit('"/>'))
    out = lines.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("gene", line.alias("t")))).alias("l"), F.max(F.size("p") * STEP).alias("w"))
    return out.select("cluster", _svg(F.col("w"), F.array_join(F.transform("l", lambda x: x["t"]), "")).alias("svg"))


def logo_svg(rows: DataFrame) -> DataFrame:
    """(motif_info_id, svg): at each position the bases, the likelier ones above, as high as their part of its information (2 bits being all)."""
    p = {b: F.col(b.lower()).cast("double") for b in COLOURS}
    bits = F.lit(2.0)
    for x in p.values():
        bits = bits + F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    stack = F.sort_array(F.array(*[F.struct(F.round(HEIGHT * F.greatest(bits, F.lit(0.0)) / 2 * x).cast("long").alias("h"), F.lit(b).alias("b"), F.lit(COLOURS[b]).alias("c")) for b, x in p.items()]))
    text = lambda x, i, up: F.format_string('<text x="%d" y="%d" font-size="%d" fill="%s">%s</text>', i * STEP, HEIGHT - up, x["h"], x["c"], x["b"])
    below = lambda s, k: F.aggregate(F.slice(s, 1, k), F.lit(0).cast("long"), lambda a, x: a + x["h"])
    d = rows.groupBy("motif_info_id").agg(F.sort_array(F.collect_list(F.struct("pos", stack.alias("s")))).alias("l"))
    column = lambda e, i: F.array_join(F.transform(e["s"], lambda x, k: F.when(x["h"] > 0, text(x, i, below(e["s"], k))).otherwise("")), "")
    return d.select("motif_info_id", _svg(F.size("l") * STEP, F.array_join(F.transform("l", column), "")).alias("svg"))


def positions_svg(annotations: DataFrame) -> DataFrame:
    """(cluster, seqtype, svg): a bar for each place of a motif, a line for each gene, reverse ones below it."""
    own = ["iteration", "cluster", "seqtype"]
    line = (F.dense_rank().over(W.partitionBy(*own).orderBy("gene")) - 1) * STEP + F.when(F.col("reverse"), STEP // 2).otherwise(0)
    d = annotations.withColumn("_line", line)
    place = F.struct((F.floor(F.col("_line") / STEP)).alias("gene"), "position", "motif_num", F.col("_line").alias("y"), "length")  # numbers only; texts are made in order
    out = d.groupBy(*own).agg(F.sort_array(F.collect_list(place)).alias("l"), F.max(F.col("position") + F.col("length")).alias("w"))
    bar = lambda x: F.format_string('<rect class="m%d" x="%d" y="%d" width="%d" height="4"/>', x["motif_num"], x["position"], x["y"], x["length"])
    return out.select(*own, _svg(F.col("w"), F.array_join(F.transform("l", bar), "")).alias("svg"))


def cluster_page(rows: DataFrame) -> DataFrame:
    """(iteration, cluster, html) from one row a cluster (see ``results.cluster_rows``)."""
    items = lambda c: F.array_join(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), "")
    head = F.format_string("<h1>Cluster %d</h1><p>residual %.4f, e-value %.3e</p>", F.col("cluster"), F.col("residual").cast("double"), F.col("evalue").cast("double"))
    body = F.concat(head, F.lit("<h2>Rows</h2><ul>"), items("rows"), F.lit("</ul><h2>Columns</h2><ul>"), items("cols"), F.lit("</ul>"))
    return rows.select("iteration", "cluster", F.concat(F.lit("<!DOCTYPE html><html><body>"), body, F.lit("</body></html>")).alias("html"))


def index_page(stats: DataFrame) -> DataFrame:
    """(iteration, html): a table of an iteration's clusters, the smallest residual first."""
    row = F.format_string('<tr><td><a href="cluster-%d.html">%d</a></td><td>%d</td><td>%d</td><td>%.4f</td></tr>', F.col("cluster"), F.col("cluster"), F.col("num_rows"), F.col("num_cols"), F.col("residual").cast("double"))
    d = stats.groupBy("iteration").agg(F.sort_array(F.collect_list(F.struct("residual", "cluster", row.alias("t")))).alias("l"))
    table = F.concat(F.lit("<table><tr><th>cluster</th><th>rows</th><th>columns</th><th>residual</th></tr>"), F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("</table>"))
    return d.select("iteration", F.concat(F.lit("<!DOCTYPE html><html><body>"), table, F.lit("</body></html>")).alias("html"))

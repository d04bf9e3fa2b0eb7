"""Names: thesauri, patches, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def map_from(lines: DataFrame, key: str, value: str, line: str = "line") -> DataFrame:
    """Each key's value on its last line."""
    return lines.groupBy(key).agg(F.max_by(value, line).alias(value))


def thesaurus(lines: DataFrame, original: str = "original", alternatives: str = "alternatives", line: str = "line", sep: str = ";") -> DataFrame:
    """alias -> original of each name itself and of those listed with it; later lines win."""
    own = lines.select(F.col(original).alias("alias"), F.col(original).alias("original"), line)
    more = lines.select(F.explode(F.split(F.col(alternatives), sep)).alias("alias"), F.col(original).alias("original"), line)
    both = own.unionByName(more.withColumn("alias", F.trim("alias"))).filter("alias <> ''")
    return both.groupBy("alias").agg(F.max_by("original", F.struct(line, "original")).alias("original"))


def mapped(names: DataFrame, thesaurus_: DataFrame, name: str = "name", *, keep: bool = False) -> DataFrame:
    """Names by their originals; unknown ones go, or stay as they are."""
    t = thesaurus_.select(F.col("alias").alias(name), "original")
    return names.join(t, name, "left").withColumn("original", F.coalesce("original", name)) if keep else names.join(t, name)


def known_share(names: DataFrame, thesaurus_: DataFrame, name: str = "name") -> DataFrame:
    """One row: the share of names in the thesaurus, and whether it is over a half."""
    d = names.join(thesaurus_.select(F.col("alias").alias(name)).distinct().withColumn("_k", F.lit(1)), name, "left")
    return d.agg(F.avg(F.col("_k").isNotNull().cast("double")).alias("share")).withColumn("ok", F.col("share") > 0.5)


#: Species whose names differ between databases, and a taxonomy number that stands for another.
SPECIES_EXCEPTIONS = {"Pseudomonas aeruginosa PAO1": "Pseudomonas aeruginosa", "Campylobacter jejuni NCTC11168": "Campylobacter jejuni"}
TAXONOMY_EXCEPTIONS = {"83333": "511145"}


def patched(organism: str, name: Column) -> Column:
    """Spellings of an organism's gene names as the networks have them.

    Names are known by how they begin: bth has plasmid genes (p...) and BT with a number, son SO with a number, cac CA_.
    """
    if organism == "bth":
        numbered = F.when(F.regexp_like(name, F.lit(r"^BT\d")), F.replace(name, F.lit("BT"), F.lit("BT_"))).otherwise(name)
        return F.when(name.startswith("p"), F.concat(F.lit("BT_"), F.replace(name, F.lit("_"), F.lit("")))).otherwise(numbered)
    if organism == "son":
        return F.when(F.regexp_like(name, F.lit(r"^SO\d")), F.replace(name, F.lit("SO"), F.lit("SO_"))).otherwise(name)
    return F.when(name.startswith("CA_"), F.replace(name, F.lit("CA_"), F.lit("CA"))).otherwise(name) if organism == "cac" else name


def patched_species(name: Column) -> Column:
    out = name
    for old, new in SPECIES_EXCEPTIONS.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def patched_taxonomy(number: Column) -> Column:
    out = number
    for old, new in TAXONOMY_EXCEPTIONS.items():
        out = F.when(number == old, new).otherwise(out)
    return out


def by_feature(names: DataFrame, thesaurus_: DataFrame, name: str = "name") -> DataFrame:
    """(id, name): the row name that a feature stands for, the last one by name if there are several."""
    return mapped(names.select(name).distinct(), thesaurus_, name).groupBy(F.col("original").alias("id")).agg(F.max(name).alias(name))


def by_oligo(cells: DataFrame, oligos: DataFrame) -> DataFrame:
    """Cells (oligo, col, value) under the genes of a map (oligo, gene, line); of an oligo's lines the last counts."""
    return cells.join(map_from(oligos, "oligo", "gene"), "oligo").select("gene", "col", "value")


def combinations(items: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """All ways to take k items of a group (lists of a few), as sorted arrays; none for k below 1."""
    if k < 1:
        return items.select(*by, F.array(item).alias("items")).limit(0)
    own = items.select(*by, item).distinct()
    out = own.select(*by, F.array(item).alias("items"))
    for _ in range(k - 1):
        out = out.join(own, by).filter(F.col(item) > F.element_at("items", -1)).select(*by, F.concat("items", F.array(item)).alias("items"))
    return out


def without_vng_modification(name: Column) -> Column:
    """VNG####xm also as VNG####x."""
    return F.when(F.regexp_like(name, F.lit(r"^VNG\d{4}.m$")), F.array(name, F.regexp_replace(name, "m$", ""))).otherwise(F.array(name))


def best_links(links: DataFrame, wanted: str, text: str = "link") -> DataFrame:
    """All links of least edit distance to a text."""
    d = links.withColumn("distance", F.levenshtein(F.col(text), F.lit(wanted)).cast("long"))
    least = d.agg(F.min("distance").alias("_m"))
    return d.crossJoin(F.broadcast(least)).filter("distance = _m").drop("_m")


def best_links_by(links: DataFrame, by: str, wanted: str, text: str = "link") -> DataFrame:
    d = links.withColumn("distance", F.levenshtein(F.col(text), F.col(wanted)).cast("long"))
    return d.withColumn("_r", F.rank().over(W.partitionBy(by).orderBy("distance"))).filter("_r = 1").drop("_r")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th; but 111st."""
    tens = n.isin(11, 12, 13)
    last = n % 10
    return F.concat(n.cast("string"), F.when(tens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))

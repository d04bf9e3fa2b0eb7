"""Search for motifs: words, steps of a model, scans and likeness."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import mismatches as X
from ..operators import motifs as M
from .base import query, r6

BASE = """SELECT weak / total AS a, 0.5 - weak / total AS c, 0.5 - weak / total AS g, weak / total AS t
    FROM (SELECT sum(len(seq) - len(replace(replace(seq, 'A', ''), 'T', '')))::DOUBLE + 2 AS weak, 2 * (sum(len(seq))::DOUBLE + 4) AS total FROM seqs) q"""
REVCOMP = "reverse(translate({}, 'ACGT', 'TGCA'))"
WORDS = f"""SELECT cluster, word, count(*) AS n FROM (SELECT DISTINCT cluster, id, least(w, {REVCOMP.format("w")}) AS word
    FROM (SELECT cluster, id, substr(seq, i, 6) AS w FROM (SELECT cluster, id, seq, unnest(range(1, len(seq) - 4)) AS i FROM seqs) x) y) z GROUP BY 1, 2"""


@query("motif_words", "SELECT cluster, word, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS i FROM wo) q WHERE i <= 8", wo=WORDS)
def _(v):
    """Words from which a cluster's models start."""
    d = D.words(v.seqs)
    best = D.best_words(v.seqs).select("cluster", F.explode("words").alias("word"))
    return best.join(d, ["cluster", "word"])


LETTER = "CASE substr({w}, k, 1) WHEN 'A' THEN {p}a WHEN 'C' THEN {p}c WHEN 'G' THEN {p}g ELSE {p}t END"
NEW = "round((sum(CASE WHEN substr(w, k, 1) = '{u}' THEN z ELSE 0 END) + 0.5 * max(b.{l})) / (sum(z) + 0.5), 6) + 0.0 AS {l}"


@query(
    "motif_step",
    f"SELECT cluster, k AS pos, {', '.join(NEW.format(u=x, l=x.lower()) for x in 'ACGT')}, round(greatest(0.01, least(0.99, sum(z) / count(DISTINCT id))), 6) + 0.0 AS share FROM zs, ks, b GROUP BY 1, 2",
    b=BASE,
    wo=WORDS,
    ks="SELECT unnest([1, 2, 3, 4, 5, 6]) AS k",
    st="SELECT cluster, word FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS i FROM wo) q WHERE i = 1",
    pl=f"SELECT cluster, id, i, unnest([w, {REVCOMP.format('w')}]) AS w, 2 * (n - 5) AS places FROM (SELECT cluster, id, i, substr(seq, i, 6) AS w, len(seq) AS n FROM (SELECT cluster, id, seq, unnest(range(1, len(seq) - 4)) AS i FROM seqs) x) y",
    # of a letter: 0.4 of the background, and 0.6 more if it is the word's, over the background
    uw=f"SELECT cluster, w, exp(sum(ln((0.4 * q + CASE WHEN substr(w, k, 1) = substr(word, k, 1) THEN 0.6 ELSE 0 END) / q))) AS ratio FROM (SELECT x.cluster, w, word, k, {LETTER.format(w='w', p='b.')} AS q FROM (SELECT DISTINCT cluster, w FROM pl) x JOIN st ON st.cluster = x.cluster, ks, b) y GROUP BY 1, 2",
    lr="SELECT pl.cluster, id, pl.w, 0.5 / places * ratio AS r FROM pl JOIN uw ON uw.cluster = pl.cluster AND uw.w = pl.w",
    zs="SELECT cluster, id, w, r / (0.5 + sum(r) OVER (PARTITION BY cluster, id)) AS z FROM lr",
)
def _(v):
    """One step of expectation maximisation from each cluster's best word."""
    d = D.first_steps(v.seqs, D.base_frequencies(v.seqs))
    return d.select("cluster", "pos", *[r6(x).alias(x) for x in ("a", "c", "g", "t", "share")])


MATRIX = "(x.{l} + 0.01 * b.{l}) / (x.a + x.c + x.g + x.t + 0.01) / b.{l}"
SCAN = {
    "b": BASE,
    "o": "SELECT rowid, cluster FROM (SELECT rowid, cluster, row_number() OVER (PARTITION BY cluster ORDER BY evalue, rowid) AS i FROM motif_infos WHERE iteration = 2 AND seqtype = 'upstream' AND rowid IN (SELECT motif_info_id FROM motif_pssm_rows)) q WHERE i <= 2",
    "mr": "SELECT motif_info_id AS rowid, row_number() OVER (PARTITION BY motif_info_id ORDER BY pos) AS k, a::DOUBLE AS a, c::DOUBLE AS c, g::DOUBLE AS g, t::DOUBLE AS t FROM motif_pssm_rows WHERE motif_info_id IN (SELECT rowid FROM o)",
    "ms": f"SELECT x.rowid, x.k, {', '.join(f'CAST(floor(log2({MATRIX.format(l=l)}) * 10 + 0.5) AS INTEGER) AS {l}' for l in 'acgt')} FROM mr x, b",
    "wd": "SELECT rowid, max(k) AS width FROM ms GROUP BY 1",
    "pl": "SELECT id, width, i, substr(seq, i, width) AS w FROM (SELECT id, seq, width, unnest(range(1, len(seq) - width + 2)) AS i FROM seqs, (SELECT DISTINCT width FROM wd) y) x",
    "us": f"SELECT width, w, {REVCOMP.format('w')} AS rc FROM (SELECT DISTINCT width, w FROM pl) x",
    "sc": f"SELECT wd.rowid, w, sum({LETTER.format(w='w', p='ms.')}) AS f, sum({LETTER.format(w='rc', p='ms.')}) AS r FROM us JOIN wd ON wd.width = us.width JOIN ms ON ms.rowid = wd.rowid GROUP BY 1, 2",
    "hi": "SELECT sc.rowid, pl.id, min({'s': -greatest(f, r), 'i': i, 'r': r > f}) AS h, count(*) * 2 AS places FROM pl JOIN wd ON wd.width = pl.width JOIN sc ON sc.rowid = wd.rowid AND sc.w = pl.w GROUP BY 1, 2",
    "d0": "SELECT rowid, 0 AS s, 1.0::DOUBLE AS p FROM wd",
}
#: The distribution of a word's score, a column more each time; no matrix has more than seven.
for k in range(1, 8):
    SCAN[f"d{k}"] = f"""SELECT rowid, s, sum(p) AS p FROM (SELECT d.rowid, d.s + CASE l WHEN 'a' THEN ms.a WHEN 'c' THEN ms.c WHEN 'g' THEN ms.g ELSE ms.t END AS s,
        d.p * CASE l WHEN 'a' THEN b.a WHEN 'c' THEN b.c WHEN 'g' THEN b.g ELSE b.t END AS p FROM d{k - 1} d JOIN ms ON ms.rowid = d.rowid AND ms.k = {k}, b, (SELECT unnest(['a', 'c', 'g', 't']) AS l) y
        UNION ALL SELECT d.rowid, d.s, d.p FROM d{k - 1} d JOIN wd ON wd.rowid = d.rowid WHERE width < {k}) x GROUP BY 1, 2"""
SCAN |= {
    "ta": "SELECT x.rowid, x.s, least(1.0, sum(d.p)) AS p FROM (SELECT DISTINCT rowid, -h.s AS s FROM hi) x JOIN d7 d ON d.rowid = x.rowid AND d.s >= x.s GROUP BY 1, 2",
    "ht": "SELECT cluster, o.rowid AS motif_num, hi.id, h.i AS position, h.r AS reverse, -h.s AS score, p AS hit_pvalue, 1 - pow(1 - p, places) AS pvalue FROM hi JOIN ta ON ta.rowid = hi.rowid AND ta.s = -h.s JOIN o ON o.rowid = hi.rowid",
    "cp": "SELECT cluster, id, sum(ln(pvalue)) AS s, count(*) AS n FROM ht GROUP BY 1, 2",
}


def scanned(v):
    """The best places of the two best motifs of each cluster in all sequences."""
    place = F.row_number().over(W.partitionBy("cluster").orderBy("evalue", "rowid"))
    m = v.motif_infos.filter("iteration = 2 AND seqtype = 'upstream'").join(v.motif_pssm_rows, F.col("rowid") == F.col("motif_info_id"), "left_semi")
    m = m.withColumn("_i", place).filter("_i <= 2").select("rowid", "cluster")
    row = F.struct("pos", F.array(*[F.col(x).cast("double") for x in "acgt"]).alias("r"))
    p = v.motif_pssm_rows.groupBy(F.col("motif_info_id").alias("rowid")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("pssm"))
    return D.scan(m.join(p, "rowid").withColumnRenamed("rowid", "motif_num"), v.seqs, D.base_frequencies(v.seqs))


@query("motif_scan", "SELECT cluster, motif_num, id, position::INTEGER AS position, reverse, score::INTEGER AS score, round(hit_pvalue, 9) + 0.0 AS hit_pvalue, round(pvalue, 9) + 0.0 AS pvalue FROM ht", **SCAN)
def _(v):
    d = scanned(v)
    return d.select("cluster", "motif_num", "id", "position", "reverse", "score", *[(F.round(x, 9) + 0.0).alias(x) for x in ("hit_pvalue", "pvalue")])


@query(
    "motif_scan_scores",
    "SELECT id AS gene, cluster, round(ln(least(1.0, exp(s) * list_sum(list_transform(range(0, n), lambda i: pow(-s, i) / gamma(i + 1))))), 6) + 0.0 AS score FROM cp",
    **SCAN,
)
def _(v):
    """Scores of all genes from the scan: a cluster's motifs taken together."""
    p = D.combined_pvalues(scanned(v)).withColumnRenamed("id", "gene")
    return M.motif_scores(p).withColumn("score", r6("score"))


@query("discovered_motifs")
def _(v):
    """Two motifs of each run of 25 sequences, as rows of their matrices."""
    seqs = v.seqs.select(F.floor(F.col("id") / 25).alias("cluster"), "id", "seq")
    d = D.discover(seqs, D.base_frequencies(seqs))
    d = d.select("cluster", "motif_num", "width", "evalue", F.size("sites").alias("sites"), F.posexplode("pssm").alias("pos", "r"))
    return d.select("cluster", "motif_num", "width", "evalue", "sites", "pos", *[F.col("r")[i].alias(x) for i, x in enumerate("acgt")])


@query("motif_likeness")
def _(v):
    """Matrices of all motifs of an iteration that are like one another, equal ones as a class, and the classes' motifs."""
    m = v.motif_infos.filter("iteration = 2 AND seqtype = 'upstream'").select(F.col("rowid").alias("id"))
    row = F.struct("pos", F.array(*[F.col(x).cast("double") for x in "acgt"]).alias("r"))
    p = v.motif_pssm_rows.groupBy(F.col("motif_info_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("pssm"))
    return D.compare_classes(m.join(p, "id"), D.base_frequencies(v.seqs), threshold=0.1)


@query(
    "mismatch_words",
    f"""SELECT hw.cluster, hw.w AS word, count(*) AS n, count(*) FILTER (WHERE hw.e = 0) AS exact, round(sum(-ln(1 - pow(1 - p, places))), 6) + 0.0 AS score
        FROM hw JOIN pw ON pw.w = hw.w AND pw.e = hw.e JOIN (SELECT cluster, count(*) AS every FROM gs GROUP BY 1) c ON c.cluster = hw.cluster
        WHERE hw.w <= {REVCOMP.format("hw.w")} GROUP BY hw.cluster, hw.w, every HAVING count(*) * 100 >= 80 * every""",
    lt="SELECT unnest(['A', 'C', 'G', 'T']) AS l",
    ks="SELECT unnest([1, 2, 3, 4, 5, 6]) AS k",
    al="SELECT concat(a.l, b.l, c.l, d.l, e.l, f.l) AS w FROM lt a, lt b, lt c, lt d, lt e, lt f",
    nb="SELECT w, w AS u, 0 AS e FROM al UNION ALL SELECT w, concat(substr(w, 1, k - 1), l, substr(w, k + 1)), 1 FROM al, ks, lt WHERE substr(w, k, 1) <> l",
    gs="SELECT floor(id / 25)::BIGINT AS cluster, id, seq, 2 * (len(seq) - 5) AS places FROM seqs WHERE len(seq) >= 6",
    ww=f"SELECT cluster, id, places, unnest([w, {REVCOMP.format('w')}]) AS w FROM (SELECT cluster, id, places, substr(seq, i, 6) AS w FROM (SELECT *, unnest(range(1, len(seq) - 4)) AS i FROM gs) x) y",
    bg="SELECT al.w, (1 + count(ww.w))::DOUBLE / (4096 + (SELECT count(*) FROM ww)) AS f FROM al LEFT JOIN ww ON ww.w = al.w GROUP BY 1",
    pw="SELECT nb.w, e.e, sum(f) AS p FROM nb JOIN bg ON bg.w = nb.u JOIN (SELECT unnest([0, 1]) AS e) e ON nb.e <= e.e GROUP BY 1, 2",
    hw="SELECT x.cluster, x.id, places, nb.w, min(e) AS e FROM (SELECT DISTINCT cluster, id, places, w FROM ww) x JOIN nb ON nb.u = x.w GROUP BY ALL",
)
def _(v):
    """Words of six letters that four fifths of each run of 25 sequences have with at most one of them changed."""
    seqs = v.seqs.select(F.floor(F.col("id") / 25).alias("cluster"), "id", "seq")
    d = X.mismatch_words(seqs, X.word_background(v.seqs), ((6, 1),), quorum=80)
    return d.select("cluster", "word", F.col("n").cast("long").alias("n"), F.col("exact").cast("long").alias("exact"), r6("score").alias("score"))


@query("mismatch_motifs")
def _(v):
    """Matrices of eight letters from the two best words with up to two mismatches of each run of 25 sequences."""
    seqs = v.seqs.select(F.floor(F.col("id") / 25).alias("cluster"), "id", "seq")
    d = X.word_motifs(seqs, D.base_frequencies(v.seqs), background=X.word_background(v.seqs))
    d = d.select("cluster", "motif_num", "width", "evalue", F.size("sites").alias("sites"), F.posexplode("pssm").alias("pos", "r"))
    return d.select("cluster", "motif_num", "width", "evalue", "sites", "pos", *[F.col("r")[i].alias(x) for i, x in enumerate("acgt")])

"""Names, sequences and motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names as N
from ..operators import sequences as S
from .base import query

RC = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"
KMERS = "SELECT {k}::BIGINT AS k, substr(seq, i, {k}) AS kmer, count(*) AS times FROM (SELECT seq, unnest(generate_series(1, length(seq) - {k} + 1)) AS i FROM seqs WHERE length(seq) >= {k}) q GROUP BY 2"


@query("revcomp", f"SELECT id, {RC.format('seq')} AS rc FROM seqs")
def _(v):
    return v.seqs.select("id", S.revcomp(F.col("seq")).alias("rc"))


def located(v):
    return v.seqs.select("id", "seq", "reverse", (F.col("id") % 60 + 20).alias("start"), (F.col("id") % 60 + 60).alias("end"))


PART = "CASE WHEN least(b, length(seq) + 1) > greatest(a, 1) THEN substr(seq, greatest(a, 1)::BIGINT, (least(b, length(seq) + 1) - greatest(a, 1))::BIGINT) ELSE '' END"
WINDOW = f"SELECT id, CASE WHEN reverse THEN {RC.format('part')} ELSE part END AS seq FROM (SELECT id, reverse, {PART} AS part FROM w) q"


@query("upstream_window", WINDOW, l="SELECT id, seq, reverse, id % 60 + 20 AS s, id % 60 + 60 AS e FROM seqs", w="SELECT id, seq, reverse, CASE WHEN reverse THEN e + 1 - 20 ELSE s - 1 - 30 END AS a, CASE WHEN reverse THEN e + 1 + 30 ELSE s - 1 + 20 END AS b FROM l")
def _(v):
    return located(v).select("id", S.upstream(F.col("seq"), F.col("start"), F.col("end"), F.col("reverse"), -20, 30).alias("seq"))


@query("downstream_window", WINDOW, l="SELECT id, seq, reverse, id % 60 + 20 AS s, id % 60 + 60 AS e FROM seqs", w="SELECT id, seq, reverse, CASE WHEN reverse THEN s - 30 ELSE e - 5 END AS a, CASE WHEN reverse THEN s + 5 ELSE e + 30 END AS b FROM l")
def _(v):
    return located(v).select("id", S.downstream(F.col("seq"), F.col("start"), F.col("end"), F.col("reverse"), -5, 30).alias("seq"))


@query("subsequence", f"SELECT id, {PART} AS part FROM (SELECT id, seq, id % 11 - 3 AS a, id % 90 + 5 AS b FROM seqs) q")
def _(v):
    return v.seqs.select("id", S.subsequence(F.col("seq"), F.col("id") % 11 - 3, F.col("id") % 90 + 5, F.lit(False)).alias("part"))


@query("mask_atg", "SELECT id, CASE WHEN length(seq) >= 24 THEN concat(substr(seq, 1, 20), 'NNNN', substr(seq, 25)) ELSE seq END AS seq FROM seqs")
def _(v):
    return v.seqs.select("id", S.masked(F.col("seq"), 20).alias("seq"))


@query("unique_sequences", "SELECT cluster, min(id) AS id, seq FROM seqs GROUP BY cluster, seq")
def _(v):
    return S.unique_sequences(v.seqs).select("cluster", "id", "seq")


@query("kmer_counts", KMERS.format(k=3))
def _(v):
    return S.kmers(v.seqs, 3)


@query("markov_background", "SELECT k, kmer, round(times / sum(times) OVER (PARTITION BY k), 9) AS freq FROM kc", kc=" UNION ALL ".join(f"({KMERS.format(k=k)})" for k in (1, 2, 3)))
def _(v):
    return S.background(v.seqs, 2).select("k", "kmer", F.round("freq", 9).alias("freq"))


@query("fasta_lines", "SELECT id, concat('>', CAST(id AS VARCHAR), chr(10), seq) AS text FROM seqs WHERE length(seq) > 0")
def _(v):
    return S.fasta_lines(v.seqs)


LETTER = "CASE WHEN greatest(a, c, g, t) < 0.4 THEN 'n' WHEN greatest(a, c, g, t) < 0.7 THEN lower({0}) ELSE {0} END"
TOP = "CASE WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END"


@query("consensus", f"SELECT motif_info_id, string_agg({LETTER.format(TOP)}, '' ORDER BY pos) AS consensus, count(*) AS length FROM motif_pssm_rows GROUP BY 1")
def _(v):
    return S.consensus(v.motif_pssm_rows, ["motif_info_id"])


@query("consensus_largest", f"SELECT motif_info_id, string_agg({TOP}, '' ORDER BY pos) AS consensus, count(*) AS length FROM motif_pssm_rows GROUP BY 1")
def _(v):
    return S.consensus(v.motif_pssm_rows, ["motif_info_id"], how=S.largest_letter)


IUPAC = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in S.IUPAC.items()) + " END"
FIRST = lambda n: f"array_to_string(list_sort([x.l FOR x IN s[1:{n}]]), '')"


@query(
    "consensus_iupac",
    f"SELECT motif_info_id, string_agg(CASE WHEN w1 >= 0.6 THEN s[1].l WHEN w1 + w2 >= 0.6 THEN {IUPAC.format(FIRST(2))} WHEN w1 + w2 + w3 >= 0.8 THEN {IUPAC.format(FIRST(3))} ELSE 'N' END, '' ORDER BY pos) AS consensus, count(*) AS length FROM l GROUP BY 1",
    l="SELECT motif_info_id, pos, s, -s[1].w AS w1, -s[2].w AS w2, -s[3].w AS w3 FROM (SELECT motif_info_id, pos, list_sort([{'w': -a::DOUBLE, 'l': 'A'}, {'w': -c::DOUBLE, 'l': 'C'}, {'w': -g::DOUBLE, 'l': 'G'}, {'w': -t::DOUBLE, 'l': 'T'}]) AS s FROM motif_pssm_rows) q",
)
def _(v):
    d = v.motif_pssm_rows.select("motif_info_id", "pos", *[F.col(x).cast("double") for x in "acgt"])
    return S.consensus(d, ["motif_info_id"], how=S.iupac_letter)


@query("log_odds", "SELECT motif_info_id, pos, CAST(round(log2(CASE WHEN a = 0 THEN 0.01 ELSE a END / 0.3)) AS BIGINT) AS a, CAST(round(log2(CASE WHEN c = 0 THEN 0.01 ELSE c END / 0.2)) AS BIGINT) AS c FROM motif_pssm_rows")
def _(v):
    d = v.motif_pssm_rows.select("motif_info_id", "pos", F.col("a").cast("double"), F.col("c").cast("double"))
    return d.select("motif_info_id", "pos", S.log_odds(F.col("a"), F.lit(0.3)).cast("long").alias("a"), S.log_odds(F.col("c"), F.lit(0.2)).cast("long").alias("c"))


@query(
    "thesaurus_explode",
    "SELECT alias, arg_max(original, (line, original)) AS original FROM (SELECT n_name AS alias, n_name AS original, n_nationkey AS line FROM {nation} UNION ALL SELECT trim(unnest(string_split(concat('N', CAST(n_nationkey AS VARCHAR), '; R', CAST(n_regionkey AS VARCHAR)), ';'))), n_name, n_nationkey FROM {nation}) q GROUP BY alias",
)
def _(v):
    lines = v.nation.select(F.col("n_name").alias("original"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit("; R"), F.col("n_regionkey").cast("string")).alias("alternatives"), F.col("n_nationkey").alias("line"))
    return N.thesaurus(lines)


@query("thesaurus_map", "SELECT name, coalesce(original, name) AS original FROM (SELECT s_name AS name FROM {supplier} UNION ALL SELECT c_name FROM {customer}) q LEFT JOIN thesaurus ON alias = name")
def _(v):
    names = v.supplier.select(F.col("s_name").alias("name")).unionByName(v.customer.select(F.col("c_name").alias("name")))
    return N.mapped(names, v.thesaurus, keep=True).select("name", "original")


@query("thesaurus_map_inner", "SELECT name, original FROM (SELECT s_name AS name FROM {supplier} UNION ALL SELECT c_name FROM {customer}) q JOIN thesaurus ON alias = name")
def _(v):
    names = v.supplier.select(F.col("s_name").alias("name")).unionByName(v.customer.select(F.col("c_name").alias("name")))
    return N.mapped(names, v.thesaurus).select("name", "original")


@query("last_value_map", "SELECT c_nationkey AS k, arg_max(c_name, c_custkey) AS v FROM {customer} GROUP BY 1")
def _(v):
    return N.map_from(v.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("line")), "k", "v")


@query("check_names", "SELECT round(avg(CASE WHEN alias IS NULL THEN 0.0 ELSE 1.0 END), 9) AS share, avg(CASE WHEN alias IS NULL THEN 0.0 ELSE 1.0 END) > 0.5 AS ok FROM (SELECT s_name AS name FROM {supplier} UNION ALL SELECT c_name FROM {customer}) q LEFT JOIN (SELECT DISTINCT alias FROM thesaurus) t ON alias = name")
def _(v):
    names = v.supplier.select(F.col("s_name").alias("name")).unionByName(v.customer.select(F.col("c_name").alias("name")))
    return N.known_share(names, v.thesaurus).select(F.round("share", 9).alias("share"), "ok")


@query("name_patches", "SELECT s_suppkey, concat('BT_', CAST(s_suppkey AS VARCHAR)) AS bth, concat('SO_', CAST(s_suppkey AS VARCHAR)) AS son, concat('CA', CAST(s_suppkey AS VARCHAR)) AS cac FROM {supplier}")
def _(v):
    key = F.col("s_suppkey").cast("string")
    return v.supplier.select("s_suppkey", *[N.patched(o, F.concat(F.lit(p), key)).alias(o) for o, p in (("bth", "BT"), ("son", "SO"), ("cac", "CA_"))])


@query("best_links", "SELECT page_id, link, d AS distance FROM (SELECT *, rank() OVER (PARTITION BY page_id ORDER BY d) AS r FROM (SELECT DISTINCT page_id, link, levenshtein(link, 'the/en') AS d FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([a-zA-Z]*)\"', 1)) AS link FROM {pages}) q) w) z WHERE r = 1")
def _(v):
    links = v.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([a-zA-Z]*)"'), 1)).alias("link")).distinct()
    return N.best_links_by(links.withColumn("w", F.lit("the/en")), "page_id", "w").select("page_id", "link", "distance")


@query("ordinals", "SELECT o_orderkey AS n, concat(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey IN (11, 12, 13) THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END) AS text FROM {orders}")
def _(v):
    return v.orders.select(F.col("o_orderkey").alias("n"), N.ordinal(F.col("o_orderkey")).alias("text"))

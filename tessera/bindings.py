"""Engine views over the driver's tables: one SQL text a view, the same on Spark and on any ANSI engine.

Genes are suppliers (or parts), conditions are quarters (or years) of shipment, values are logarithms of
sales. ``{table}`` stands for a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
CLUSTERS = 8

VIEWS: dict[str, str] = {
    "cells": """SELECT l_suppkey AS gene, CAST(EXTRACT(YEAR FROM l_shipdate) * 10 + EXTRACT(QUARTER FROM l_shipdate) AS BIGINT) AS cond,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents FROM {lineitem} GROUP BY 1, 2""",
    "expr": "SELECT gene, cond, round(ln(cents / 100), 6) AS value FROM cells",
    "part_cells": """SELECT l_partkey AS gene, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS cond,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents FROM {lineitem} GROUP BY 1, 2""",
    # a full grid: sales that a part has not had in a year are NULL
    "expr_sparse": """SELECT g.gene, c.cond, round(ln(x.cents / 1000000), 6) AS value FROM (SELECT DISTINCT gene FROM part_cells) g
        CROSS JOIN (SELECT DISTINCT cond FROM part_cells) c LEFT JOIN part_cells x ON x.gene = g.gene AND x.cond = c.cond""",
    "genes": "SELECT DISTINCT gene FROM expr",
    "conds": "SELECT DISTINCT cond FROM expr",
    "row_memb": f"""SELECT gene, CAST(0 AS BIGINT) AS slot, 1 + gene % {CLUSTERS} AS cluster FROM genes
        UNION ALL SELECT gene, CAST(1 AS BIGINT), 1 + (gene * 7 + 3) % {CLUSTERS} FROM genes WHERE (gene * 7 + 3) % {CLUSTERS} <> gene % {CLUSTERS}""",
    "col_memb": f"""SELECT cond, CAST(0 AS BIGINT) AS slot, 1 + cond % {CLUSTERS} AS cluster FROM conds
        UNION ALL SELECT cond, CAST(1 AS BIGINT), 1 + (cond + 1) % {CLUSTERS} FROM conds
        UNION ALL SELECT cond, CAST(2 AS BIGINT), 1 + (cond + 3) % {CLUSTERS} FROM conds""",
    "edges": """SELECT 'first' AS network, a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight, min(a.l_orderkey) AS line
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 GROUP BY 2, 3
        UNION ALL SELECT 'second', a.l_suppkey, b.l_suppkey, CAST(count(*) AS DOUBLE), min(a.l_orderkey)
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 2 AND b.l_linenumber = 3 GROUP BY 2, 3""",
    # neighbours on one strand
    "predictions": """SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey + 1
        WHERE a.s_nationkey % 2 = b.s_nationkey % 2""",
    "known": "SELECT s_suppkey AS gene FROM {supplier} WHERE s_acctbal >= 2000",
    "sets": """SELECT 'nation' AS set_type, concat('N', CAST(s_nationkey AS STRING)) AS set_name, s_suppkey AS gene FROM {supplier}
        UNION ALL SELECT 'balance', concat('B', CAST(CAST(floor(s_acctbal / 1000) AS BIGINT) AS STRING)), s_suppkey FROM {supplier}""",
    "thesaurus": """SELECT s_name AS alias, concat('S', CAST(s_suppkey AS STRING)) AS original, s_suppkey AS line FROM {supplier}
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('S', CAST(s_suppkey AS STRING)), s_suppkey FROM {supplier}""",
    "seqs": """SELECT doc_id AS id, doc_id % 50 AS cluster, substring(translate(concat(md5(text), md5(concat(text, '1')), md5(concat(text, '2'))), '0123456789abcdef',
        'ACGTACGTTGCAAGCT'), 1, CAST(60 + doc_id % 37 AS INT)) AS seq, doc_id % 2 = 0 AS reverse FROM {documents}""",
    "runs": """SELECT event_type AS logtype, event_id % 100 + 1 AS iteration, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS active,
        round(value, 4) AS scaling, event_id AS rowid FROM {events}""",
    "cluster_stats": """SELECT o_custkey % 10 + 1 AS iteration, CAST(o_orderkey % 40 + 1 AS BIGINT) AS cluster, count(*) AS num_rows,
        count(DISTINCT o_orderpriority) AS num_cols, round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000000, 6) AS residual
        FROM {orders} GROUP BY 1, 2""",
    "statstypes": """SELECT CAST(1 AS BIGINT) AS statstype, 'main' AS category, 'median_residual' AS name UNION ALL SELECT 2, 'main', 'fuzzy_coeff'
        UNION ALL SELECT 3, 'network', 'operons' UNION ALL SELECT 4, 'network', 'string' UNION ALL SELECT 5, 'seqtype', 'upstream' UNION ALL SELECT 6, 'scoring', 'Rows'""",
    "iteration_stats": "SELECT user_id % 6 + 1 AS statstype, event_id % 100 + 1 AS iteration, round(value, 4) AS score, event_id AS rowid FROM {events}",
    "row_names": "SELECT s_suppkey AS order_num, s_name AS name FROM {supplier}",
    "column_names": "SELECT CAST(n_nationkey AS BIGINT) AS order_num, n_name AS name FROM {nation}",
    "row_members": "SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS iteration, l_orderkey % 20 + 1 AS cluster, l_suppkey AS order_num FROM {lineitem}",
    "column_members": """SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS iteration, l_orderkey % 20 + 1 AS cluster, CAST(s_nationkey AS BIGINT) AS order_num
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "motif_infos": """SELECT p_partkey AS rowid, CAST(p_size % 7 + 1 AS BIGINT) AS iteration, p_partkey % 20 + 1 AS cluster,
        CASE WHEN p_partkey % 3 = 0 THEN 'p3utr' ELSE 'upstream' END AS seqtype, p_partkey % 2 + 1 AS motif_num, round(p_retailprice / 100000, 8) AS evalue FROM {part}""",
    "motif_pssm_rows": """SELECT DISTINCT l_partkey AS motif_info_id, CAST(l_linenumber AS BIGINT) AS pos, (l_partkey * 3 + l_linenumber) % 7 / 10.0 AS a, (l_partkey + l_linenumber * 5) % 11 / 20.0 AS c,
        (l_partkey * 2 + l_linenumber) % 5 / 10.0 AS g, (l_partkey + l_linenumber) % 3 / 10.0 AS t FROM {lineitem}""",
    "motif_annotations": """SELECT l_orderkey * 8 + l_linenumber AS rowid, l_partkey AS motif_info_id, l_suppkey AS gene_num, CAST(l_quantity AS BIGINT) AS position,
        l_returnflag = 'R' AS reverse, round(l_discount, 4) AS pvalue FROM {lineitem}""",
    "tomtom_results": "SELECT l_partkey AS motif_info_id1, l_suppkey AS motif_info_id2, min(round(l_tax, 4)) AS pvalue FROM {lineitem} WHERE l_partkey <> l_suppkey GROUP BY 1, 2",
}


def needed(sql: str) -> list[str]:
    """Views that an SQL text refers to, directly or not, in an order in which they can be defined."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def oracle(body: str, **more: str) -> str:
    """A query over the views as one SQL text for the driver's engine; ``more`` are further views, in order."""
    text = " ".join([*more.values(), body])
    parts = [f"{n} AS ({VIEWS[n]})" for n in needed(text)] + [f"{n} AS ({s})" for n, s in more.items()]
    return re.sub(r"\{(\w+)\}", r"\1", f"WITH {', '.join(parts)} {body}" if parts else body)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = needed(f"SELECT * FROM {name}")
    text = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + f" SELECT * FROM {name}"
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))

"""The iteration: score, combine, reassign; a driver loop over small state in written tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators import discovery as D
from ..operators import enrichment
from ..operators import membership as B
from ..operators import mismatches as X
from ..operators import motifs as M
from ..operators import rescoring as R
from ..operators import scoring as S
from ..operators import stats
from ..operators.networks import network_score_means, network_scores, network_sums
from ..operators.results import motif_tables
from ..operators.sequences import low_complexity_masked
from .config import Config, Schedule, default_clusters, fuzzy_coefficient, scaling

#: A scoring function: (run, iteration) -> (gene, cluster, score), or None if it has none.
Scorer = Callable[["Run", int], DataFrame | None]
SCORERS: dict[str, Scorer] = {}
#: A column scoring function: run -> (cond, cluster, score).
COLUMN_SCORERS: dict[str, Callable[["Run"], DataFrame]] = {}
#: How a function's scores are summed up for the statistics, where it isn't by the mean of all cells.
MEANS: dict[str, Callable[["Run", DataFrame], float | None]] = {}
#: The folder of save points in a run's.
POINTS = "savepoints"


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Registers a scoring function under the name that schedules, scalings and pipelines know it by."""

    def register(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return register


def _means(run: Run) -> DataFrame:
    """Clusters' means, which row and column scores share."""
    return run.rescored("centres", lambda k: S.cluster_means(run.matrix, R.of(run.rows, k)))


@scorer("Rows")
def _rows(run: Run, iteration: int) -> DataFrame:
    means = _means(run)
    own = lambda k: S.row_scores(run.matrix, R.of(run.rows, k), R.of(run.cols, k), R.of(means, k))
    return run.rescored("Rows", own, cols=True)


def _sums(run: Run) -> DataFrame:
    """Weights of edges to clusters, which scores and statistics share."""
    return run.rescored("sums", lambda k: network_sums(run.edges, R.of(run.rows, k)))


@scorer("Networks")
def _networks(run: Run, iteration: int) -> DataFrame | None:
    """Networks count alike: each has the weight 1 / networks, unless the run has weights."""
    if run.edges is None:
        return None
    weights = run.network_weights
    if weights is None:
        names = run.edges.select("network").distinct()
        weights = names.crossJoin(F.broadcast(names.agg((1 / F.count("*")).alias("weight"))))  # one row
    sums = _sums(run)
    return run.rescored("Networks", lambda k: network_scores(run.edges, R.of(run.rows, k), run.genes, weights, R.of(sums, k)))


@scorer("Motifs")
def _motifs(run: Run, iteration: int) -> DataFrame | None:
    """Of the last search, which has a schedule of its own (MEME)."""
    return None if run.pvalues is None else M.motif_scores(run.pvalues)


@scorer("SetEnrichment")
def _sets(run: Run, iteration: int) -> DataFrame | None:
    """On the scale of the first function's scores; the best set of each cluster goes to the table ``best_sets``."""
    if run.sets is None or run.functions[0] not in run.cached:
        return None
    (reference,) = stats.quantiles(run.cached[run.functions[0]], "score", [0.1])
    best = tables.keep(enrichment.best_sets(run.rows, run.sets), "sets")
    run.store("best_sets", best, iteration)
    return enrichment.scores(run.rows, run.sets, run.config.clusters, reference or 0.0, run.set_weights, best=best)


def _columns(run: Run) -> DataFrame:
    clusters = run.spark.range(1, run.config.clusters + 1).select(F.col("id").alias("cluster"))
    means = _means(run)
    found = run.rescored("cells", lambda k: S.column_scores(run.matrix, R.of(run.rows, k), R.of(means, k)))
    return S.filled_column_scores(found, run.conds, clusters, run.cols)


#: A search: (cluster, id, seq) with low complexity masked, all sequences, background, number of motifs -> motifs as ``discovery.discover`` gives them.
Search = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


def search_motifs(run: Run, iteration: int, search: Search = lambda own, seqs, base, number: D.discover(own, base, number)) -> tuple[DataFrame, DataFrame]:
    """The search that runs use where they have sequences: p-values (cluster, gene, pvalue) and motifs (see ``motif_tables``).

    Only clusters whose sequences are others than in the last search are searched and scanned; the rest keep their motifs and places.
    """
    number = int(scaling(run.config.nmotifs, run.config.num_iterations)(iteration))
    seqs = run.sequences.select("id", "seq").distinct()
    own = run.kept(M.cluster_sequences(run.rows, run.sequences), f"searched-{iteration}")
    last, old = run.search_state, None
    fresh, base = own, D.base_frequencies(seqs)
    if last is not None and last[0] == number:
        before, motifs, places = (run.spark.read.parquet(f"{run.folder}/{x}-{last[1]}") for x in ("searched", "found", "places"))
        changed = tables.keep(M.changed(own, before), "changed")
        fresh = own.join(changed, "cluster", "left_semi")
        stays = own.select("cluster").distinct().join(changed, "cluster", "left_anti")
        old = [x.join(stays, "cluster", "left_semi") for x in (motifs, places)]
    filtered = low_complexity_masked(fresh) if run.config.mask_sequences else fresh
    found = tables.keep(search(filtered, seqs, base, number), "found")
    hits = D.scan(found, seqs, base)
    if old is not None:
        found, hits = found.unionByName(old[0]), hits.unionByName(old[1])
    found, hits = run.kept(found, f"found-{iteration}"), run.kept(hits, f"places-{iteration}")
    run.search_state = number, iteration
    genes = run.sequences.select("id", "gene").distinct()
    pvalues = D.combined_pvalues(hits).join(genes, "id").groupBy("cluster", "gene").agg(F.min("pvalue").alias("pvalue"))
    return pvalues, D.as_results(found, hits.filter(F.col("hit_pvalue") <= run.config.annotate), own, genes)


def search_words(run: Run, iteration: int) -> tuple[DataFrame, DataFrame]:
    """The same by words with mismatches."""
    return search_motifs(run, iteration, lambda own, seqs, base, number: X.word_motifs(own, base, number, background=X.word_background(seqs)))


COLUMN_SCORERS["Columns"] = _columns
MEANS["Motifs"] = lambda run, scores: M.mean_score(scores, run.rows).first()[0]


def functions_of(pipeline: dict) -> tuple[tuple[str, ...], str]:
    """Names of the row scoring functions and of the column scoring function that a pipeline's JSON text lists."""
    top = pipeline["row-scoring"]
    if not top["function"]["class"].endswith("Combiner"):
        raise ValueError("the top of row scoring must be a combiner")
    rows, cols = tuple(f["id"] for f in top["args"]["functions"]), pipeline["column-scoring"]["id"]
    if unknown := [*(set(rows) - set(SCORERS)), *({cols} - set(COLUMN_SCORERS))]:
        raise ValueError(f"no scoring function is registered as {', '.join(sorted(unknown))}")
    return rows, cols


def default_functions(*, networks: bool = True, motifs: bool = True) -> tuple[str, ...]:
    return ("Rows", *(["Networks"] if networks else []), *(["Motifs"] if motifs else []))


@dataclass
class Run:
    """matrix (gene, cond, value) and what functions need besides; ``folder`` is shared by all executors and has what iterations made.

    edges (network, src, dst, weight); sets (set_type, set_name, gene) with set_weights (set_type, weight); sequences (gene, id, seq), in
    which motifs are searched; or find_motifs, which gives for a run and an iteration the p-values (cluster, gene, pvalue) of
    another motif search, and its motifs (see ``motif_tables``) or None.
    The result tables: row_names, column_names, row_members, column_members, cluster_stats, statstypes, iteration_stats,
    run_logs, run_infos, best_sets, motif_infos and what belongs to it.
    """

    spark: SparkSession
    matrix: DataFrame
    folder: str
    config: Config
    edges: DataFrame | None = None
    network_weights: DataFrame | None = None
    sets: DataFrame | None = None
    set_weights: DataFrame | None = None
    sequences: DataFrame | None = None
    find_motifs: Callable[[Run, int], tuple[DataFrame, DataFrame | None]] | None = None
    seqtype: str = "upstream"
    functions: tuple[str, ...] = ("Rows", "Networks")
    column_function: str = "Columns"
    log: list[tuple[str, int, int, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.matrix = self.kept(self.matrix.select("gene", "cond", "value"), "matrix")
        if self.edges is not None:  # every iteration reads them, so what they are made from is read once
            self.edges = self.kept(self.edges.select("network", "src", "dst", "weight"), "edges")
        if self.sets is not None:
            self.sets = self.kept(self.sets.select("set_type", "set_name", "gene"), "sets")
        self.genes, self.conds = (self.kept(self.matrix.select(x).distinct(), f"{x}s") for x in ("gene", "cond"))
        self.n_genes, self.n_conds = self.genes.count(), self.conds.count()
        k, per_col = default_clusters(self.n_genes, self.n_conds, self.config.per_row)
        self.config.clusters = self.config.clusters or max(1, k)
        self.config.per_col = self.config.per_col or max(1, min(self.config.clusters, per_col))
        for table, d, name in (("row_names", self.genes, "gene"), ("column_names", self.conds, "cond")):
            self.kept(stats.counted(d, name).select(F.col("low").alias("order_num"), F.col(name).alias("name")), table)
        if self.sequences is not None:
            self.sequences = self.kept(self.sequences.select("gene", "id", F.upper("seq").alias("seq")), "sequences")
            self.find_motifs = self.find_motifs or search_motifs
        self.search_state: tuple[int, int] | None = None
        self.cached: dict[str, DataFrame] = {}
        self.means: dict[str, float | None] = {}
        self.pvalues: DataFrame | None = None
        self.motifs: DataFrame | None = None
        self.scored: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}  # what a cluster's members give, and the rows and columns then
        self.read: list[tuple[str, int, int]] = []  # what was scored again, when, and for how many clusters
        self.compared: dict[tuple, tuple[DataFrame, int]] = {}  # in this iteration
        self.now, self.logged, self.saved, self.finished = 0, 0, {0}, False
        self.started = datetime.now()

    @classmethod
    def of_pipeline(cls, pipeline: dict | str, *args: object, **more: object) -> Run:
        """A run of the functions in a pipeline's JSON (text, or as read); motifs of a class that names Weeder are searched by words."""
        pipeline = json.loads(pipeline) if isinstance(pipeline, str) else pipeline
        rows, cols = functions_of(pipeline)
        if any("Weeder" in f["class"] for f in pipeline["row-scoring"]["args"]["functions"] if "class" in f):
            more.setdefault("find_motifs", search_words)
        return cls(*args, functions=rows, column_function=cols, **more)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.opened(name)

    def opened(self, name: str) -> DataFrame:
        out = self.spark.read.parquet(f"{self.folder}/{name}")
        out._tessera_name = name
        return out

    def rescored(self, name: str, score: Callable[[DataFrame | None], DataFrame], *, cols: bool = False) -> DataFrame:
        """What ``score`` gives for clusters, as a table of this iteration. It is asked for all (None) at first, and then for those whose
        rows, or with ``cols`` whose columns, are others than the last time; the rest keep what they have."""
        last, called = self.scored.get(name), f"{name}-{self.now}"
        if last is not None and last[0]._tessera_name == called:
            if last[1] is self.rows and last[2] is self.cols:
                return last[0]
            last = None  # an iteration once more
        if last is None:
            out = self.kept(score(None), called)
        else:
            clusters, n = self._changed(last[1], last[2] if cols else None)
            self.read.append((name, self.now, n))
            out = self.kept(R.rescored(last[0], clusters, score), called) if n else last[0]
        self.scored[name] = out, self.rows, self.cols
        return out

    def store(self, table: str, df: DataFrame, iteration: int) -> None:
        """Rows of an iteration in a folder of its own: written again, they replace what was there."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/iteration={iteration}")

    def seed(self) -> None:
        """Rows by k-means, columns where the clusters' columns score best."""
        conds = [r[0] for r in self.conds.orderBy("cond").collect()]
        rows = B.seed_kmeans(self.matrix, self.config.clusters, conds, self.config.seed)
        rows = self.kept(rows, "rows-seed")
        cols = S.seed_columns(self.matrix, rows, self.config.per_col).withColumn("slot", F.col("slot").cast("long"))
        self.start(rows, cols)

    def _changed(self, rows: DataFrame, cols: DataFrame | None) -> tuple[DataFrame, int]:
        """Clusters whose rows or columns are others than these, and their number; functions scored in the same iterations share them."""
        x = lambda d: None if d is None else d._tessera_name
        key = x(self.rows), x(rows), *((x(self.cols), x(cols)) if cols is not None else ())
        if key not in self.compared:
            logs = [R.changes(self.rows, rows, "gene"), *([R.changes(self.cols, cols, "cond")] if cols is not None else [])]
            clusters = self.kept(R.changed(*logs), f"changed{len(self.compared)}-{self.now}")
            self.compared[key] = clusters, clusters.count()
        return self.compared[key]

    def start(self, rows: DataFrame, cols: DataFrame) -> None:
        """From given memberships (gene or cond, slot, cluster)."""
        tables.remove(self.spark, f"{self.folder}/{POINTS}")
        self.rows = self.kept(B.padded(rows, self.genes, "gene", self.config.per_row), "rows-start")
        self.cols = self.kept(B.padded(cols, self.conds, "cond", self.config.per_col), "cols-start")

    def resume(self, iteration: int | None = None) -> int:
        """Goes on behind an iteration whose memberships were saved, with every function scored anew; or, without one, behind the
        last save point, with all it names. Gives the iteration; 0 where there is no save point."""
        if iteration is not None:
            tables.remove(self.spark, f"{self.folder}/{POINTS}")
            self.rows, self.cols = (self.opened(f"{x}-{iteration}") for x in ("rows", "cols"))
            self.saved.add(iteration)
            return iteration
        points = [int(x.partition("=")[2]) for x in tables.names(self.spark, f"{self.folder}/{POINTS}")]
        whole = [i for i in points if "_SUCCESS" in tables.names(self.spark, f"{self.folder}/{POINTS}/iteration={i}")]
        if not whole:
            return 0
        s = json.loads(self.spark.read.text(f"{self.folder}/{POINTS}/iteration={max(whole)}", wholetext=True).first()[0])
        opened: dict[str, DataFrame] = {}
        table = lambda x: None if x is None else opened.setdefault(x, self.opened(x))
        self.rows, self.cols, self.pvalues, self.motifs = (table(s[x]) for x in ("rows", "cols", "pvalues", "motifs"))
        self.cached = {k: table(x) for k, x in s["cached"].items()}
        self.scored = {k: tuple(map(table, x)) for k, x in s["scored"].items()}
        self.means, self.saved, self.finished = s["means"], set(s["saved"]), s["finished"]
        self.config.clusters, self.config.per_col = s["clusters"], s["per_col"]
        self.search_state = None if s["search"] is None else tuple(s["search"])
        self.log, self.logged = [tuple(x) for x in s["log"]], 0
        self.started, self.now = datetime.fromisoformat(s["started"]), max(whole)
        self._sweep(max(whole))
        return max(whole)

    def commit(self, iteration: int) -> None:
        """The iteration's save point: the names of all tables that the next one needs, written when those are. Only then goes what
        earlier ones needed, so a run that is killed anywhere finds the last save point whole."""
        name = lambda d: None if d is None else d._tessera_name
        s = {x: name(getattr(self, x)) for x in ("rows", "cols", "pvalues", "motifs")}
        s |= {"cached": {k: name(d) for k, d in self.cached.items()}, "scored": {k: [name(d) for d in x] for k, x in self.scored.items()}}
        s |= {"means": self.means, "saved": sorted(self.saved), "finished": self.finished, "search": self.search_state}
        s |= {"clusters": self.config.clusters, "per_col": self.config.per_col, "log": self.log[self.logged :], "started": self.started.isoformat()}
        self.spark.createDataFrame([(json.dumps(s),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{POINTS}/iteration={iteration}")
        self._sweep(iteration)

    def _sweep(self, point: int) -> None:
        """Removes tables of iterations that nothing names any more, and other save points."""
        frames = [self.rows, self.cols, self.pvalues, self.motifs, *self.cached.values(), *(d for x in self.scored.values() for d in x)]
        live = {d._tessera_name for d in frames if d is not None} | {f"{x}-{i}" for x in ("rows", "cols") for i in self.saved}
        if self.search_state is not None:
            live |= {f"{x}-{self.search_state[1]}" for x in ("searched", "found", "places")}
        gone = [x for x in tables.names(self.spark, self.folder) if re.search(r"-\d+$", x) and x not in live]
        old = [f"{POINTS}/{x}" for x in tables.names(self.spark, f"{self.folder}/{POINTS}") if x != f"iteration={point}"]
        for x in (*old, *gone):
            tables.remove(self.spark, f"{self.folder}/{x}")

    def _active(self, name: str, iteration: int) -> bool:
        return Schedule(self.config.schedules.get(name, "1,1"))(iteration)

    def _search(self, iteration: int, force: bool) -> None:
        if self.find_motifs is None or "Motifs" not in self.functions or not (force or self._active("MEME", iteration)):
            return
        pvalues, motifs = self.find_motifs(self, iteration)  # in the step's scope
        self.pvalues = self.kept(pvalues.select("cluster", "gene", "pvalue"), f"pvalues-{iteration}")
        self.motifs = None if motifs is None else self.kept(motifs, f"motifs-{iteration}")

    def scores(self, iteration: int, force: bool = False) -> DataFrame | None:
        """Combined scores; a function out of schedule stands with its last scores, which are never changed. They read tables that
        the scope around the call drops."""
        got, self.now, self.compared = [], iteration, {}
        self._search(iteration, force)
        for name in self.functions:
            active = force or self._active(name, iteration)
            if active and (s := SCORERS[name](self, iteration)) is not None:
                self.cached[name] = s if hasattr(s, "_tessera_name") else self.kept(s, f"{name}-{iteration}")
                mean = MEANS.get(name, lambda run, d: (d.agg(F.sum("score")).first()[0] or 0.0) / max(1, run.n_genes * run.config.clusters))
                self.means[name] = mean(self, self.cached[name])
            factor = scaling(self.config.scalings.get(name, "1"), self.config.num_iterations)(iteration)
            self.log.append((name, iteration, int(active), factor))
            if name in self.cached:
                got.append((name, self.cached[name], factor))
        return self._combined(got)

    def _combined(self, got: list[tuple[str, DataFrame, float]]) -> DataFrame | None:
        if not got:
            return None
        if self.config.quantile:
            union = None
            for name, s, _ in got:
                d = s.select(F.lit(name).alias("function"), "gene", "cluster", "score")
                union = d if union is None else union.unionByName(d)
            weights = self.spark.createDataFrame([(n, float(w)) for n, _, w in got], "function string, weight double")
            return S.quantile_normalise(union, weights).join(weights, "function").groupBy("gene", "cluster").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
        (_, first, factor), *others = got
        return S.combine(first, [(s, f) for _, s, f in others], self.rows, factor)

    def step(self, iteration: int, force: bool = False) -> None:
        """Scores and new memberships; what it keeps on the way is gone when it ends."""
        with tables.scope():
            self._step(iteration, force)

    def _step(self, iteration: int, force: bool) -> None:
        combined = self.scores(iteration, force)
        if force or self._active("Columns", iteration) or "Columns" not in self.cached:
            self.cached["Columns"] = self.kept(COLUMN_SCORERS[self.column_function](self), f"Columns-{iteration}")
            self.means["Columns"] = self.cached["Columns"].agg(F.avg("score")).first()[0]
        cols, seed = self.cached["Columns"], self.config.seed * 1_000_003 + iteration
        coefficient = fuzzy_coefficient(iteration, self.config.num_iterations)
        if combined is not None:
            if self.config.add_fuzz in ("rows", "both"):
                combined = S.fuzz(combined, self.rows, "gene", coefficient, seed)
            dense = S.density(combined, self.rows, "gene", rows=True, other=self.cols)
            sized = S.size_factor(dense, B.counts(self.rows, "gene"), self.n_genes, self.config.per_row, self.config.clusters, self.config.min_rows)
            rows = B.update(self.rows, sized, "gene", self.config.per_row, rows=True, probability=self.config.prob_row_change, changes=self.config.max_changes_row, seed=seed)
        else:
            rows = self.rows
        if self.config.add_fuzz in ("columns", "both"):
            cols = S.fuzz(cols, self.cols, "cond", coefficient, seed)
        n = self.n_conds
        sized = S.size_factor(S.density(cols, self.cols, "cond", rows=False, other=self.rows), B.counts(self.cols, "cond"), n, self.config.per_col, self.config.clusters, n / 10)
        new = B.update(self.cols, sized, "cond", self.config.per_col, rows=False, probability=self.config.prob_col_change, changes=self.config.max_changes_col, seed=seed)
        self.rows, self.cols = self.kept(rows, f"rows-{iteration}"), self.kept(new, f"cols-{iteration}")

    def stats(self, iteration: int, clusters: DataFrame | None = None) -> DataFrame:
        """Of each cluster, or of some: its size and residual."""
        rows, cols = R.of(self.rows, clusters), R.of(self.cols, clusters)
        m = self.matrix.join(S.members(rows, "gene"), "gene").join(S.members(cols, "cond"), ["cond", "cluster"])
        d = B.counts(rows, "gene").withColumnRenamed("n", "num_rows").join(B.counts(cols, "cond").withColumnRenamed("n", "num_cols"), "cluster", "left")
        d = d.join(stats.residual(m, ["cluster"], "gene", "cond"), "cluster", "left")
        return d.select(F.lit(iteration).alias("iteration"), "cluster", "num_rows", F.coalesce("num_cols", F.lit(0)).alias("num_cols"), F.coalesce("residual", F.lit(1.0)).alias("residual"))

    def save_stats(self, iteration: int) -> None:
        """cluster_stats, and iteration_stats by category and name: fuzzy coefficient, median residual, mean scores of functions, networks and motifs."""
        self.now = iteration
        clusters = self.rescored("sizes", lambda k: self.stats(iteration, k).drop("iteration"), cols=True)
        self.store("cluster_stats", clusters, iteration)
        main = {"fuzzy_coeff": fuzzy_coefficient(iteration, self.config.num_iterations), "median_residual": stats.quantiles(clusters, "residual", [0.5])[0] or 1.0}
        rows = [("main", k, v) for k, v in main.items()] + [("scoring", k, v) for k, v in self.means.items()]
        if self.edges is not None and "Networks" in self.functions:
            rows += [("network", r["network"], r["mean"]) for r in network_score_means(self.edges, self.rows, self.genes, _sums(self)).collect()]  # a row for each network
        if self.means.get("Motifs") is not None:
            rows.append(("seqtype", self.seqtype, self.means["Motifs"]))
        self.store("iteration_stats", self.spark.createDataFrame([(c, n, None if s is None else float(s)) for c, n, s in rows], "category string, name string, score double").coalesce(1), iteration)
        new, self.logged = self.log[self.logged :], len(self.log)
        if new:
            self.store("run_logs", self.spark.createDataFrame([(n, i, a, float(f)) for n, i, a, f in new], "logtype string, at int, active int, scaling double").coalesce(1), iteration)
        self._info(iteration)

    def save(self, iteration: int) -> None:
        """Members by their numbers, and the last search's motifs."""
        self.saved.add(iteration)
        for table, memb, name, names in (("row_members", self.rows, "gene", "row_names"), ("column_members", self.cols, "cond", "column_names")):
            numbers = self.spark.read.parquet(f"{self.folder}/{names}").withColumnRenamed("name", name)
            self.store(table, S.members(memb, name).join(numbers, name).select("cluster", "order_num"), iteration)
        if self.motifs is not None:
            numbers = self.spark.read.parquet(f"{self.folder}/row_names")
            for table, d in motif_tables(self.motifs, iteration, self.seqtype, numbers).items():
                self.store(table, d, iteration)

    def _info(self, last: int, finished: bool = False) -> None:
        row = (self.started, datetime.now() if finished else None, self.config.num_iterations, last, self.n_genes, self.n_conds, self.config.clusters)
        ddl = "start_time timestamp, finish_time timestamp, num_iterations int, last_iteration int, num_rows long, num_columns long, num_clusters int"
        self.spark.createDataFrame([row], ddl).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/run_infos")

    def run(self, first: int = 1) -> None:
        for i in range(first, self.config.num_iterations + 1):
            self.step(i, force=first > 1 and i == first and not self.cached)  # what was cached is gone
            if i == 1 or i % self.config.result_frequency == 0 or i == self.config.num_iterations:
                self.save(i)
            if i == 1 or i % self.config.stats_frequency == 0 or i == self.config.num_iterations:
                with tables.scope():
                    self.save_stats(i)
            self.commit(i)

    def finish(self) -> None:
        """Adds each cluster's nearest genes and scores once more, as iteration num_iterations + 1."""
        if not self.finished:
            with tables.scope():
                self._finish()

    def _finish(self) -> None:
        last = self.config.num_iterations + 1
        got = [(n, self.cached[n], scaling(self.config.scalings.get(n, "1"), self.config.num_iterations)(last - 1)) for n in self.functions if n in self.cached]
        combined = self._combined(got)
        if combined is not None and self.config.postadjust:
            self.rows = self.kept(B.postadjust(self.rows, S.density(combined, self.rows, "gene", rows=True, other=self.cols), "gene"), f"rows-{last}")
            self.scores(last, force=True)
            self.save(last)
            self.save_stats(last)
        self._info(last, finished=True)
        self.finished = True
        self.commit(last)

"""A trained critic of cells: evidence of constraints, pooled with learned weights, and how well the rest of a row predicts a cell.

Cells are learned from without labels: copies of some rows get one synthetic error each. Scores are cross-fitted: each row is
scored once, by a model whose counts, groups and weights come from other rows alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewarden.functions import cells as C
from tablewarden.plans.quantiles import quantiles
from tablewarden.plans.tables import cells, share_package, shared_folder, spread, written

from .constraints import Constraint, decisions, evidence_features, execute
from .encoding import synthetic_value
from .models import averaged, cell_pairs, fold as fold_of, highest_losses, loss, pair_counts, prediction_gain, votes

#: The order of families and of their features in an evidence vector.
FAMILIES = ("missing", "format", "semantic", "domain", "statistical", "neighbor", "relation")
PARTS = ("violation", "passed", "reliability", "support", "coverage", "disagreement")

#: Kinds of models by name; a name is registered once.
MODELS: dict[str, Callable] = {}


def register_model(name: str) -> Callable[[Callable], Callable]:
    def keep(f: Callable) -> Callable:
        if name in MODELS:
            raise ValueError(f"there is a model {name} already")
        MODELS[name] = f
        return f

    return keep


def build_model(name: str, **params):
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; known are {sorted(MODELS)}")
    return MODELS[name](**params)


def evidence_vectors(evidence: DataFrame) -> DataFrame:
    """row_id, column, evidence and covered: the features of all families of each cell, 7 x 6 values, 0 for families that say
    nothing, and the share of families that say something."""
    f = evidence_features(evidence).select("row_id", "column", F.struct("family", F.array(*PARTS).alias("parts")).alias("of"))
    f = f.groupBy("row_id", "column").agg(F.map_from_entries(F.collect_list("of")).alias("of"))  # at most seven
    none = F.array_repeat(F.lit(0.0), len(PARTS))
    every = F.flatten(F.transform(F.array(*map(F.lit, FAMILIES)), lambda name: F.coalesce(F.try_element_at("of", name), none)))
    return f.select("row_id", "column", every.alias("evidence"), (F.size("of") / len(FAMILIES)).alias("covered"))


def peers(df: DataFrame, keys: list[str], most: int = 8, block: int = 100_000, salts: int = 16) -> DataFrame:
    """row_id and peers: of each row the ids of up to `most` others with the same keys, evenly spaced in the order of ids.

    Rows get their place by counts of blocks of ids; of a group only the places that some row wants (at most twice `most`) are
    gathered, and rows of one group are joined with them in `salts` parts.
    """
    named = [f"k{i}" for i in range(len(keys))]
    rows = df.dropna(subset=keys).select("row_id", *(F.col(k).alias(n) for k, n in zip(keys, named)), F.floor(F.col("row_id") / block).alias("_block"))
    counts = rows.groupBy(*named, "_block").agg(F.count("*").alias("_n"))
    groups = W.partitionBy(*named)
    counts = counts.withColumn("_before", F.sum("_n").over(groups.orderBy("_block")) - F.col("_n")).withColumn("_size", F.sum("_n").over(groups)).drop("_n").where("_size > 1")
    place = F.row_number().over(W.partitionBy(*named, "_block").orderBy("row_id")) - 1
    rows = written(rows.join(counts, [*named, "_block"]).select("row_id", *named, "_size", (place + F.col("_before")).alias("_place")), "places")
    others = F.col("_size") - 1
    n = F.least(F.lit(most), others)
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(n > 1, F.floor(j * (others - 1) / F.greatest(n - 1, F.lit(1)))).otherwise(0).cast("long"))
    wanted = F.array_union(spaced, F.transform(spaced, lambda p: p + 1))
    picked = rows.where(F.array_contains(wanted, F.col("_place").cast("long"))).groupBy(*named).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_place").cast("long"), "row_id"))).alias("_at"))
    picked = picked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    mine = F.transform(spaced, lambda p: F.element_at("_at", p + F.when(p >= F.col("_place"), 1).otherwise(0)))
    return salted.join(picked, [*named, "_salt"]).select("row_id", mine.alias("peers"))


def corrupted(df: DataFrame, columns: list[str], scales: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Copies of some rows, each with one wrong cell, and which cell that is (row_id, column, source_row, value).

    Copies have negative ids, so ids of df must not be negative. About `share` of the filled cells are drawn by a hash of the seed. scales: column
    and scale, by which numbers are moved.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "row_id", "column"), F.lit(1 << 20))
    n = len(columns)
    at = F.create_map(*(x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))))
    chosen = cells(df, columns).where(~C.is_blank(F.col("value"))).where(draw < F.lit(share * (1 << 20)))
    chosen = chosen.join(F.broadcast(scales.select("column", "scale")), "column", "left")  # one row for each column
    wrong = chosen.select((-1 - F.col("row_id") * n - F.element_at(at, F.col("column"))).alias("row_id"), "column", F.col("row_id").alias("source_row"), synthetic_value(F.col("value"), F.coalesce("scale", F.lit(1.0))).alias("value"))
    source = df.select(F.col("row_id").alias("source_row"), *(F.col(c).cast("string").alias(c) for c in columns))
    copies = wrong.join(source, "source_row").select("row_id", *(F.when(F.col("column") == c, F.col("value")).otherwise(F.col(c)).alias(c) for c in columns))
    return copies, wrong


def column_scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and scale: the quartile distance of its numbers, 1 / 1000 at least, and 1 where it has none."""
    x = cells(df, columns).select("column", C.number_with_unit(F.col("value"))["x"].alias("x"))
    q = quantiles(x, ["column"], "x", [0.25, 0.75])
    return q.select("column", F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-3)).alias("scale"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Critic:
    """Chance of an error, from the evidence of the families and other numbers of a cell (context).

    A gate scores each family that says something; the softmax of these weighs the families' projections, and a
    logistic layer reads the pooled projection and the context. Weights are stored in one vector.
    """

    def __init__(self, context: int, hidden: int = 8, seed: int = 42, weights: np.ndarray | None = None):
        self.context, self.hidden, self.parts, self.families = context, hidden, len(PARTS), len(FAMILIES)
        self.shapes = [(self.parts,), (self.parts, hidden), (hidden,), (hidden,), (context,), (1,)]
        self.sizes = [int(np.prod(s)) for s in self.shapes]
        self.weights = np.random.default_rng(seed).normal(0, 0.3, sum(self.sizes)) if weights is None else np.asarray(weights, float)

    def _split(self, w: np.ndarray) -> list[np.ndarray]:
        return [x.reshape(s) for x, s in zip(np.split(w, np.cumsum(self.sizes)[:-1]), self.shapes)]

    def forward(self, evidence: np.ndarray, context: np.ndarray, w: np.ndarray | None = None):
        gate, project, bias, out, other, shift = self._split(self.weights if w is None else w)
        e = evidence.reshape(-1, self.families, self.parts)
        covered = e[:, :, PARTS.index("coverage")] > 0
        score = np.where(covered, e @ gate, -1e4)
        share = np.exp(score - score.max(1, keepdims=True)) * covered
        share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
        raw = e @ project + bias
        hidden = np.maximum(raw, 0)
        pooled = np.einsum("nf,nfh->nh", share, hidden)
        return pooled @ out + context @ other + shift[0], (e, share, raw, hidden, pooled)

    def gradient(self, evidence: np.ndarray, context: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted logistic loss, and its derivative by all weights, of some rows: one vector, the loss first."""
        gate, project, bias, out, other, shift = self._split(w)
        z, (e, share, raw, hidden, pooled) = self.forward(evidence, context, w)
        losses = weight * (np.logaddexp(0, z) - y * z)
        dz = weight * (_sigmoid(z) - y)
        d_pooled = dz[:, None] * out
        d_hidden = share[:, :, None] * d_pooled[:, None, :] * (raw > 0)
        by_share = np.einsum("nh,nfh->nf", d_pooled, hidden)
        d_score = share * (by_share - (share * by_share).sum(1, keepdims=True))
        parts = [np.einsum("nf,nfp->p", d_score, e), np.einsum("nfp,nfh->ph", e, d_hidden), d_hidden.sum((0, 1)), pooled.T @ dz, context.T @ dz, dz.sum(keepdims=True)]
        return np.concatenate([[losses.sum(), weight.sum()], *(p.ravel() for p in parts)])

    def chance(self, evidence: np.ndarray, context: np.ndarray, odds: float = 1.0) -> np.ndarray:
        return _sigmoid(self.forward(evidence, context)[0] + np.log(odds))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


@register_model("evidence_critic")
def train_critic(examples: DataFrame, steps: int = 60, rate: float = 0.15, ridge: float = 1e-3, seed: int = 42) -> Critic:
    """A critic from examples (evidence, context, label, weight), by full gradient steps (Adam).

    Equal examples are added up before. Each step sends the weights to the tasks and gets back one sum of derivatives for each
    weight, whatever the number of rows.
    """
    spark = examples.sparkSession
    share_package(spark)
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 3))
    rows = examples.select(rounded(F.col("evidence")).alias("evidence"), rounded(F.col("context")).alias("context"), "label", "weight")
    rows = written(rows.groupBy("evidence", "context", "label").agg(F.sum("weight").alias("weight")), "examples")
    first = rows.first()
    if first is None:
        raise ValueError("no examples to learn from")
    critic = Critic(len(first["context"]), seed=seed)
    w, m, v = critic.weights, 0.0, 0.0

    def sums(now: np.ndarray) -> np.ndarray:
        def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now) + 2)
            for b in batches:
                if b.num_rows:
                    total += critic.gradient(_matrix(b.column("evidence")), _matrix(b.column("context")), b.column("label").to_numpy(zero_copy_only=False).astype(float), b.column("weight").to_numpy(zero_copy_only=False), now)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "g"])

        added = rows.mapInArrow(by_task, "place int, g double").groupBy("place").agg(F.sum("g").alias("g"))
        return np.array([r["g"] for r in sorted(added.collect())])  # as many as weights

    for step in range(1, steps + 1):
        got = sums(w)
        g = got[2:] / max(got[1], 1e-12) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    critic.weights = w
    return critic


def criticised(rows: DataFrame, critic: Critic, odds: float = 1.0) -> DataFrame:
    """rows (with evidence and context) with their score. odds: of an error, against those among the critic's examples."""
    share_package(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = critic.chance(_matrix(b.column("evidence")), _matrix(b.column("context")), odds)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    return rows.mapInArrow(run, schema)


def critic_inputs(df: DataFrame, columns: list[str], program: list[Constraint], counts: DataFrame, reference: Column, judged: Column, left_out: bool) -> DataFrame:
    """row_id, column, value, evidence, covered, surprise, other, residual, alternative of every cell of the judged rows of df.

    counts: pair_counts; reference: which rows of df count for the evidence; left_out: the judged rows are among those counted. covered: share of
    families that say something; surprise: log(1 + residual); other: whether another value is likelier.
    """
    vectors = evidence_vectors(execute(df, program, reference, judged))
    df = df.where(judged)
    scored = averaged(votes(cell_pairs(df, columns), counts, left_out=left_out)).select("row_id", "column", loss().alias("residual"), F.col("best").alias("alternative"), ((F.col("best") != F.col("value")) & (F.col("best_p") > F.col("p"))).cast("double").alias("other"))
    rows = cells(df, columns).join(vectors, ["row_id", "column"], "left").join(scored, ["row_id", "column"], "left")
    none = F.array_repeat(F.lit(0.0), len(FAMILIES) * len(PARTS))
    rows = rows.withColumn("evidence", F.coalesce("evidence", none)).na.fill(0.0, ["residual", "covered", "other"])
    return rows.select("row_id", "column", "value", "evidence", "covered", F.log1p("residual").alias("surprise"), "other", "residual", "alternative")


def sure_cells(evidence: DataFrame, sure: float = 0.8) -> DataFrame:
    """A teacher from evidence alone: row_id, column and label 1 of the cells whose best violation, by score and reliability, is sure."""
    return decisions(evidence).where(F.col("error_score") >= sure).select("row_id", "column", F.lit(1.0).alias("label"))


def usual(known: DataFrame) -> DataFrame:
    """column, and what is usual in it: the means of surprise and other."""
    return known.groupBy("column").agg(F.avg("surprise").alias("usual_surprise"), F.avg("other").alias("usual_other"))


def with_context(known: DataFrame, usual: DataFrame) -> DataFrame:
    """critic_inputs with context: surprise and other against what is usual in the column, and covered."""
    context = F.array(F.col("surprise") - F.col("usual_surprise"), F.col("other") - F.col("usual_other"), "covered")
    return known.join(F.broadcast(usual), "column").withColumn("context", context).drop("usual_surprise", "usual_other")  # one row for each column


def fingerprint(df: DataFrame, columns: list[str], program: list[Constraint], **params) -> str:
    """Of the rows of a table, whatever their order, a program and parameters."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ["row_id", *columns]))
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return hashlib.sha256(json.dumps([r["n"], str(r["s"]), r["x"], columns, [asdict(c) for c in program], params], sort_keys=True, default=str).encode()).hexdigest()[:24]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


SCORED = "row_id long, column string, value string, fold int, score double, residual double, alternative string"


def cross_fit(df: DataFrame, columns: list[str], program: list[Constraint], k: int = 3, seed: int = 42, share: float = 0.2, model: str = "evidence_critic", folder: str | None = None, teacher: DataFrame | None = None, trim: bool = True, prior: float = 0.1, **params) -> DataFrame:
    """row_id, column, value, fold, score, residual, alternative: each cell scored once, by a model that never saw its row.

    For each fold, counts, groups, scales and the critic come from the rows of the other folds. The critic learns from synthetic errors (label 1) against
    the cells they were made from and as many others (label 0, weight 1/4), and, a fifth as much, from a teacher (row_id, column, label). With `trim`
    the counts trust the cells of the highest losses less. prior: the share of wrong cells that scores are for. Every fold is
    written under `folder` (the shared folder by default) by the fingerprint of table, program and parameters: a run that is started again reads the folds that are there.
    """
    spark = df.sparkSession
    table = written(spread(df.select(F.col("row_id").cast("long").alias("row_id"), *(F.col(c).cast("string").alias(c) for c in columns))), "table")
    teacher = None if teacher is None else written(teacher.select("row_id", "column", F.col("label").cast("double").alias("label")), "teacher")
    root = f"{folder or shared_folder(spark)}/cross-fit-{fingerprint(table, columns, program, k=k, seed=seed, share=share, model=model, trim=trim, prior=prior, teacher=None if teacher is None else fingerprint(teacher, ['column', 'label'], []), **params)}"
    done = []
    for fold in range(k):
        path = f"{root}/fold={fold}"
        if not _exists(spark, path):
            rows = table.withColumn("fold", fold_of(columns, k, seed))
            train = written(rows.where(F.col("fold") != fold).drop("fold"), "train")
            pairs = cell_pairs(train, columns)
            counts = written(pair_counts(pairs), "counts")
            if trim:
                low = highest_losses(averaged(votes(pairs, counts))).select("row_id", "column", F.lit(0.1).alias("weight"))
                counts = written(pair_counts(cell_pairs(train, columns, written(low, "low-weights"))), "counts")
            copies, wrong = corrupted(train, columns, column_scales(train, columns), share, seed + fold)
            wrong = written(wrong, "wrong")
            both = written(train.unionByName(copies), "with-copies")
            known = written(critic_inputs(both, columns, program, counts, F.col("row_id") >= 0, F.lit(True), True), "inputs")
            means = written(usual(known.where("row_id >= 0")), "usual")
            known = with_context(known, means)
            ones = known.join(wrong.select("row_id", "column"), ["row_id", "column"]).select("evidence", "context", F.lit(1.0).alias("label"), F.lit(1.0).alias("weight"))
            own = known.join(wrong.select(F.col("source_row").alias("row_id"), "column"), ["row_id", "column"])
            others = known.where("row_id >= 0").where(F.pmod(F.xxhash64(F.lit(-seed), "row_id", "column"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
            zeros = own.unionByName(others).select("evidence", "context", F.lit(0.0).alias("label"), F.lit(0.25).alias("weight"))
            examples = ones.unionByName(zeros)
            if teacher is not None:
                taught = written(known.join(teacher, ["row_id", "column"]).select("evidence", "context", "label"), "taught")
                each = 0.2 * examples.count() / max(1, taught.count())  # all together a fifth of the synthetic examples
                examples = examples.unionByName(taught.withColumn("weight", F.lit(each)))
            critic = build_model(model, examples=examples, seed=seed + fold, **params)
            test = with_context(critic_inputs(rows, columns, program, counts, F.col("fold") != fold, F.col("fold") == fold, False), means)
            odds = prior / (1 - prior) * 0.5  # among the examples: one synthetic error to two cells of weight 1/4
            out = criticised(test, critic, odds).select("row_id", "column", "value", F.lit(fold).alias("fold"), "score", "residual", "alternative")
            out.write.mode("overwrite").parquet(path)
        done.append(path)
    return spark.read.schema(SCORED).parquet(*done)

"""Operator 1: mix sources to target weights, over a tree of domain, language and source.

Each node's token budget is shared among its children by weight. A child that can't use its share (its subtree has
too few tokens, even repeated `max_epochs` times) gets what it can use, and its siblings share the shortage by weight;
only what no sibling can use goes back to the parent's siblings. Each leaf then takes whole epochs of its documents
and of the last epoch, which a seed orders anew, the longest prefix within its budget.

The prefix needs no order of a whole leaf: documents fall into `bins` by their key of that epoch, tokens are summed
per bin, and only the bin where the budget ends is ordered.

Defined results: null texts have no tokens; a null language or source is a leaf named by an empty string; leaves that
the weights don't name take the weight of `*` at their level (1 if there is none); a weight of 0 selects nothing;
a leaf without tokens is taken once; repeated rows and rows that share an id
count each, by a key of all their columns that the mix reads; a table without rows gives none; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import documents, written

Path = tuple[str, ...]


@dataclass(frozen=True)
class Mix:
    """weights: by path from the root, of any depth; `*` stands for names that are not given."""

    weights: dict[Path, float] = field(default_factory=dict)
    share: float = 1.0  # of the tokens that the table holds
    max_epochs: int = 1
    seed: int = 1
    bins: int = 4096
    most_broadcast: int = 100_000  # leaves; tables of more leaves are joined by a shuffle

    def weight(self, path: Path) -> float:
        for known in (path, (*path[:-1], "*"), *((*("*",) * i, *path[i:]) for i in range(1, len(path))), ("*",) * len(path)):
            if known in self.weights:
                return self.weights[known]
        return 1.0

    def wants(self, path: Path) -> bool:
        """Whether no weight on the way to the leaf is 0."""
        return all(self.weight(path[: i + 1]) > 0 for i in range(len(path)))


def water_fill(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares of budget by weight, none above its room; what is too much for one goes to the others."""
    out, total = [0.0] * len(weights), sum(w for w in weights if w > 0)
    for i in sorted((i for i, w in enumerate(weights) if w > 0), key=lambda i: room[i] / weights[i]):  # the first to be full comes first
        out[i] = min(room[i], weights[i] * budget / total) if budget > 0 and total > 0 else 0.0
        budget, total = budget - out[i], total - weights[i]
    return out


def budgets(tokens: dict[Path, int], mix: Mix, total: float) -> dict[Path, float]:
    """The token budget of each leaf: room is summed up the tree in one pass, and budgets go down in another."""
    room: dict[Path, float] = {}
    children: dict[Path, set[Path]] = {}
    for path, n in tokens.items():
        usable = n * mix.max_epochs if mix.wants(path) else 0.0
        for i in range(len(path) + 1):
            room[path[:i]] = room.get(path[:i], 0.0) + usable
            if i:
                children.setdefault(path[: i - 1], set()).add(path[:i])
    out: dict[Path, float] = {}
    todo = [((), total)] if tokens else []
    while todo:
        prefix, budget = todo.pop()
        below = sorted(children.get(prefix, ()))
        if not below:
            out[prefix] = budget
        todo += zip(below, water_fill(budget, [mix.weight(c) for c in below], [room[c] for c in below]))
    return out


def word_tokens(text: str = "text") -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def domain_of_source() -> Column:
    """Sources with a number below 10 are the web, others are curated."""
    return F.when(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)$", 1).rlike("^[0-9]$"), "web").otherwise("curated")


def select_mix(docs: DataFrame, mix: Mix, levels: list[Column] | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of docs, once for each epoch that takes them, as struct `row` with epoch, leaf, n_tokens and budget.

    levels: the columns of the tree (domain, language and source unless given); tokens: a row's size.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    levels = levels or [domain_of_source(), F.col("lang"), F.col("source")]
    key = F.xxhash64("doc_id", "text")
    sized = docs.select(F.array(*map(name, levels)).alias("leaf"), (word_tokens() if tokens is None else tokens).alias("n_tokens"), key.alias("key"), F.struct("*").alias("row"))
    sizes = written(sized.select("leaf", "n_tokens", "key"), "sizes")
    count = {tuple(r["leaf"]): r["n"] for r in sizes.groupBy("leaf").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = budgets(count, mix, mix.share * sum(count.values()))
    full = {p: min(mix.max_epochs, int(b // count[p])) if count[p] else int(mix.wants(p)) for p, b in plan.items()}
    schema = T.StructType([T.StructField("leaf", T.ArrayType(T.StringType())), T.StructField("budget", T.DoubleType()), T.StructField("full", T.IntegerType()), T.StructField("rest", T.LongType())])
    leaves = spark.createDataFrame([(list(p), float(b), full[p], int(b - full[p] * count[p]) if full[p] < mix.max_epochs else 0) for p, b in plan.items()], schema)

    small = F.broadcast if len(plan) <= mix.most_broadcast else (lambda df: df)

    def keyed(df: DataFrame) -> DataFrame:
        """Order of a row in the last epoch of its leaf, and its bin."""
        order = F.xxhash64("key", F.col("full") + 1, F.lit(mix.seed))
        return df.join(small(leaves), "leaf").withColumn("order", order).withColumn("bin", F.shiftrightunsigned("order", 64 - (mix.bins - 1).bit_length()))

    partial = keyed(sizes).where("rest > 0")
    bins = partial.groupBy("leaf", "bin").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    bins = bins.withColumn("before", F.sum("n").over(W.partitionBy("leaf").orderBy("bin")) - F.col("n"))
    cut = written(bins.where("before <= rest and before + n > rest").select("leaf", F.col("bin").alias("cut_bin"), "before"), "cuts")
    inside = partial.join(small(cut), "leaf").where("bin = cut_bin").withColumn("upto", F.sum("n_tokens").over(W.partitionBy("leaf").orderBy("order", "key").rangeBetween(W.unboundedPreceding, 0)) + F.col("before"))
    last = written(inside.groupBy("leaf").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("order", "key"))).alias("last")), "prefixes")
    limits = leaves.join(cut.select("leaf", "cut_bin"), "leaf", "left").join(last, "leaf", "left").select("leaf", "cut_bin", "last")
    rows = keyed(sized).join(small(limits), "leaf", "left")
    in_prefix = (F.col("rest") > 0) & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(F.struct("order", "key") <= F.col("last"), F.lit(False))))
    times = F.col("full") + in_prefix.cast("int")
    rows = rows.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select("row", "epoch", "leaf", "n_tokens", "budget")


#: Weights of the registered query: the web counts twice as much as curated sources, English as much as all others.
PRODUCTION = Mix({("web",): 2.0, ("curated",): 1.0, ("*", "en"): 3.0, ("*", "*"): 1.0, ("*", "*", "src0"): 2.0}, share=0.8, max_epochs=3, seed=7)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selected document, once for each epoch."""
    out = select_mix(documents(spark, sf_dir), PRODUCTION)
    return out.select("row.doc_id", "epoch", F.col("leaf")[0].alias("domain"), F.col("leaf")[1].alias("lang"), F.col("leaf")[2].alias("source"), "n_tokens", F.round("budget", 3).alias("budget"))

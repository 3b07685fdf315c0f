"""Feature encoders of tables, fitted on reference cells: an Estimator of row vectors, and features of single cells.

Both learn from the distinct values of each column with their numbers, counted once. What grows with the data (the values) stays
a table that is joined when rows are encoded; only one row for each column comes to the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewarden.functions import cells as C
from tablewarden.plans.quantiles import quantiles
from tablewarden.plans.tables import cells, written

UNKNOWN = "__UNK__"


def blank_for_models(v: Column) -> Column:
    return C.is_blank(v, C.BLANK_FOR_MODELS)


def distinct_values(df: DataFrame, columns: list[str], dirty: DataFrame | None = None) -> DataFrame:
    """column, value, n of the cells that are neither blank nor dirty (row_id, column)."""
    long = cells(df, columns).where(~blank_for_models(F.col("value")))
    if dirty is not None:
        long = long.join(dirty.select("row_id", "column").distinct(), ["row_id", "column"], "left_anti")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def log_frequency(values: DataFrame) -> DataFrame:
    """values with frequency: log(1 + n) over the greatest one of its column."""
    top = values.groupBy("column").agg(F.max("n").alias("_top"))
    return values.join(F.broadcast(top), "column").withColumn("frequency", F.log1p("n") / F.log1p("_top")).drop("_top")  # one row for each column


@dataclass
class Encoded:
    """How a column is encoded: its kind, its first place among the features and what it was scaled by."""

    name: str
    kind: str
    start: int = 0
    width: int = 0
    n_values: int = 0
    median: float = 0.0
    iqr: float = 1.0
    length_median: float = 0.0
    length_iqr: float = 1.0


class _TabularParams(HasInputCols, HasOutputCol):
    maxCardinality = Param(Params._dummy(), "maxCardinality", "distinct values up to which a column is one-hot", TypeConverters.toInt)
    numericMinRatio = Param(Params._dummy(), "numericMinRatio", "share of numbers from which a column is numeric", TypeConverters.toFloat)
    nHash = Param(Params._dummy(), "nHash", "buckets of 3-grams of a column with more values", TypeConverters.toInt)
    idMinLength = Param(Params._dummy(), "idMinLength", "median length from which whole numbers of one length are ids", TypeConverters.toInt)
    targetMaxCard = Param(Params._dummy(), "targetMaxCard", "distinct values up to which a categorical column is a target too", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(maxCardinality=500, numericMinRatio=0.8, nHash=16, idMinLength=4, targetMaxCard=500, outputCol="features")


class TabularEncoder(Estimator, _TabularParams, DefaultParamsReadable, DefaultParamsWritable):
    """Rows as sparse vectors. A numeric column gives [scaled value, blank]; a column of few values gives [one-hot, unknown, log frequency,
    blank]; one of many gives [length, digits, letters, punctuation, spaces, log frequency, blank, known, hashed 3-grams]."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", maxCardinality=500, numericMinRatio=0.8, nHash=16, idMinLength=4, targetMaxCard=500):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fit_clean(self, df: DataFrame, dirty: DataFrame) -> TabularEncoderModel:
        """Fit on the cells that are not in dirty (row_id, column)."""
        return self._learn(df, dirty)

    def _fit(self, dataset: DataFrame) -> TabularEncoderModel:
        return self._learn(dataset, None)

    def _learn(self, df: DataFrame, dirty: DataFrame | None) -> TabularEncoderModel:
        get = self.getOrDefault
        columns = get("inputCols") or [c for c in df.columns if c != "row_id"]
        values = written(log_frequency(distinct_values(df, columns, dirty)), "values")
        v, n = F.col("value"), F.col("n")
        x, plain = C.number(v), v.try_cast("double")
        lengths = values.select("column", F.length(v).cast("double").alias("x"), "n")
        total = lambda c: F.sum(F.when(c, n).otherwise(0))
        mean = F.sum(F.length(v) * n) / F.sum(n)
        spread = (F.sum(F.length(v) * F.length(v) * n) - F.sum(n) * mean * mean) / F.nullif(F.sum(n) - 1, F.lit(0))
        stat = values.groupBy("column").agg(F.count("*").alias("k"), (total(x.isNotNull()) / F.sum(n)).alias("numbers"), (total(plain.isNotNull()) / F.sum(n)).alias("plain"), F.max(F.when(plain != F.floor(plain), 1).otherwise(0)).alias("fractions"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sd"), F.stddev_samp(x).alias("_"))
        numbers = values.select("column", x.alias("x"), "n").where("x is not null")
        squares = numbers.groupBy("column").agg(F.sum("n").alias("m"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
        wide = numbers.join(F.broadcast(squares), "column").groupBy("column").agg(F.sqrt(F.sum(F.col("n") * (F.col("x") - F.col("mean")) ** 2) / F.nullif(F.first("m") - 1, F.lit(0))).alias("x_sd"))
        q = quantiles(numbers, ["column"], "x", [0.25, 0.5, 0.75], "n").select("column", F.col("q").alias("xq"))
        ql = quantiles(lengths, ["column"], "x", [0.25, 0.5, 0.75], "n").select("column", F.col("q").alias("lq"))
        found = {r["column"]: r for r in stat.join(ql, "column").join(q, "column", "left").join(wide, "column", "left").collect()}  # one row for each column
        specs, at = [], 0
        for c in columns:
            r = found.get(c)
            spec = Encoded(c, "dropped", at)
            if r is not None:
                spec.n_values, spec.length_median, spec.length_iqr = r["k"], r["lq"][1], (r["lq"][2] - r["lq"][0]) or 1.0
                is_id = r["plain"] >= get("numericMinRatio") and not r["fractions"] and r["lq"][1] >= get("idMinLength") and r["sd"] is not None and r["sd"] <= 1.0
                if not is_id and r["numbers"] >= get("numericMinRatio"):
                    spec.kind, spec.width, spec.median = "numeric", 2, r["xq"][1]
                    spec.iqr = (r["xq"][2] - r["xq"][0]) or r["x_sd"] or 1.0
                elif r["k"] <= get("maxCardinality"):
                    spec.kind, spec.width = "categorical", r["k"] + 3
                else:
                    spec.kind, spec.width = "highcard", 8 + get("nHash")
            specs.append(spec)
            at += spec.width
        one_hot = F.col("column").isin([s.name for s in specs if s.kind == "categorical"])
        index = F.when(one_hot, F.row_number().over(W.partitionBy("column", one_hot).orderBy("value")) - 1)
        few = values.where(one_hot).withColumn("index", index)  # at most maxCardinality rows for each column
        rest = values.where(F.col("column").isin([s.name for s in specs if s.kind == "highcard"])).withColumn("index", F.lit(None).cast("int"))
        return self._copyValues(TabularEncoderModel(specs, written(few.unionByName(rest), "vocabulary")))


class TabularEncoderModel(Model, _TabularParams, MLWritable, MLReadable):
    """specs: how each column is encoded; vocabulary: column, value, n, frequency, index."""

    def __init__(self, specs: list[Encoded] | None = None, vocabulary: DataFrame | None = None):
        super().__init__()
        self.specs, self.vocabulary = specs or [], vocabulary

    @property
    def n_features(self) -> int:
        return sum(s.width for s in self.specs)

    def targets(self) -> list[dict]:
        """What can be predicted of each column: a value, one of its classes (or unknown), or how its text looks."""
        kinds = {"numeric": "numeric", "highcard": "surrogate"}
        wide = lambda s: s.kind == "categorical" and s.n_values > self.getOrDefault("targetMaxCard")
        return [{"name": s.name, "start": s.start, "width": s.width, "target": "none" if wide(s) else kinds.get(s.kind, "categorical"), "classes": s.n_values + 1 if s.kind == "categorical" else 0, "blank": s.start + {"numeric": 1, "highcard": 6}.get(s.kind, s.n_values + 2)} for s in self.specs if s.width]

    def categorical_columns(self) -> list[str]:
        return [s.name for s in self.specs if s.kind == "categorical"]

    def feature_names(self) -> DataFrame:
        """feature (its place) and name: column=value, column=__UNK__, or column#what."""
        parts = {"numeric": ["value", "blank"], "highcard": ["length", "digits", "letters", "punctuation", "spaces", "frequency", "blank", "known", *(f"hash{i}" for i in range(self.getOrDefault("nHash")))]}
        rows = [(s.start + i, f"{s.name}#{p}") for s in self.specs for i, p in enumerate(parts.get(s.kind, []))]
        for s in self.specs:
            if s.kind == "categorical":
                rows += [(s.start + s.n_values, f"{s.name}={UNKNOWN}"), (s.start + s.n_values + 1, f"{s.name}#frequency"), (s.start + s.n_values + 2, f"{s.name}#blank")]
        spark = self.vocabulary.sparkSession
        starts = spark.createDataFrame([(s.name, s.start) for s in self.specs if s.kind == "categorical"], "column string, start int")
        known = self.vocabulary.join(F.broadcast(starts), "column").select((F.col("start") + F.col("index")).alias("feature"), F.concat("column", F.lit("="), "value").alias("name"))
        return spark.createDataFrame(rows, "feature int, name string").unionByName(known)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep, rows, blocks, one_hot = [F.col(c) for c in df.columns], df, [], []
        for i, s in enumerate(self.specs):
            if not s.width:
                continue
            v, null = F.col(f"`{s.name}`").cast("string"), f"_null{i}"
            rows = rows.withColumn(null, blank_for_models(v).cast("double"))
            if s.kind == "numeric":
                x = F.coalesce(C.number(v), F.lit(s.median))
                rows = rows.withColumn(f"_x{i}", (x - s.median) / s.iqr)
                blocks += [f"_x{i}", null]
                continue
            mine = self.vocabulary.where(F.col("column") == s.name).select(F.col("value").alias(f"_v{i}"), F.col("index").alias(f"_i{i}"), F.col("frequency").alias(f"_f{i}"))
            seen = F.when(F.col(null) == 0, v)
            rows = rows.join(F.broadcast(mine) if s.kind == "categorical" else mine, seen == F.col(f"_v{i}"), "left")  # of a categorical column at most maxCardinality rows
            often = F.coalesce(f"_f{i}", F.lit(0.0))
            if s.kind == "categorical":
                rows = rows.withColumn(f"_f{i}", often).withColumn(f"_i{i}", F.coalesce(f"_i{i}", F.lit(s.n_values)).cast("double"))
                one_hot.append((i, s.n_values))
                blocks += [f"_h{i}", f"_f{i}", null]
            else:
                n = F.greatest(F.length(v), F.lit(1))
                share = lambda p, v=v, n=n: F.regexp_count(v, F.lit(p)) / n
                look = [(F.length(v) - s.length_median) / s.length_iqr, share(r"\p{Nd}"), share(r"\p{L}"), share(r"[^\p{L}\p{N}\p{Nl}(?U:\s)]"), (F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit("")))) / n, often, F.col(null), F.col(f"_v{i}").isNotNull().cast("double")]
                none = F.array(*(F.lit(1.0 if k == 6 else 0.0) for k in range(s.width)))
                grams = C.hashed_trigrams(v, self.getOrDefault("nHash")) if s.width > 8 else F.array().cast("array<double>")
                rows = rows.withColumn(f"_d{i}", array_to_vector(F.when(F.col(null) == 1, none).otherwise(F.concat(F.array(*look), grams))))
                blocks.append(f"_d{i}")
        if one_hot:
            ends = df.sparkSession.createDataFrame([tuple(float(k) for _, k in one_hot)], [f"_i{i}" for i, _ in one_hot])  # one row: the last index of each column
            rows = OneHotEncoder(inputCols=ends.columns, outputCols=[f"_h{i}" for i, _ in one_hot], dropLast=False).fit(ends).transform(rows)
        out = self.getOrDefault("outputCol")
        rows = VectorAssembler(inputCols=blocks, outputCol="_features").transform(rows)
        return rows.select(*keep, F.col("_features").alias(out))

    def write(self) -> MLWriter:
        return _TabularWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TabularReader()


class _TabularWriter(MLWriter):
    def __init__(self, model: TabularEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        params = {p.name: m.getOrDefault(p) for p in m.params if m.isDefined(p)}
        text = json.dumps({"params": params, "specs": [asdict(s) for s in m.specs]})
        m.vocabulary.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/specs")
        m.vocabulary.write.parquet(f"{path}/vocabulary")


class _TabularReader(MLReader):
    def load(self, path: str) -> TabularEncoderModel:
        spark = SparkSession.getActiveSession() or self.sparkSession
        state = json.loads(spark.read.text(f"{path}/specs", wholetext=True).first()[0])
        model = TabularEncoderModel([Encoded(**s) for s in state["specs"]], spark.read.parquet(f"{path}/vocabulary"))
        return model._set(**state["params"])


#: Places of cell features: the scaled number first, seven of how the text looks, its frequency, whether it has a unit; from GRAMS on hashed n-grams.
FEATURES, GRAMS, BUCKETS = 48, 16, 32


def lexical(v: Column) -> Column:
    """The 48 features of a text that need no reference: blank, length, digits, letters, white space, others, upper case, and its hashed
    1-, 2- and 3-grams scaled to length 1. Buckets are the first 32 bits of MD5, which SQL engines agree on."""
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    upper = ((v == F.upper(v)) & (v != F.lower(v))).cast("double")
    look = [F.lit(0.0), C.is_blank(v).cast("double"), F.least(F.length(v) / 100, F.lit(5.0)), share(r"\p{Nd}"), share(r"\p{L}"), share(r"(?U)\s"), share(r"(?U)[^\s\p{L}\p{N}]"), upper, *[F.lit(0.0)] * (GRAMS - 8)]
    size = F.sequence(F.lit(1), F.lit(3))
    grams = F.flatten(F.transform(size, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(v) - k + 1, F.lit(1))), lambda i: F.substr(v, i, k))))
    bucket = F.transform(grams, lambda g: F.conv(F.substr(F.md5(g.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % BUCKETS)
    counts = C.once(bucket, lambda hit: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter(hit, lambda x: x == b)).cast("double")))
    scaled = C.once(counts, lambda n: C.once(F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(n, lambda x: x / norm)))
    return F.concat(F.array(*look), scaled)


class CellEncoder:
    """Features of single cells, scaled by a reference: the median and quartile distance of each column's numbers, the frequency of
    its values, and numbers of the values of columns that have few.

    Every distinct value of a column is encoded once, and joined with its cells.
    """

    def __init__(self, reference: DataFrame, columns: list[str], max_categories: int = 500, vectors: DataFrame | None = None):
        """vectors: value and vector, as a SemanticStore gives them; they are appended to the features."""
        self.columns, self.vectors = columns, vectors
        v, n = F.col("value"), F.col("n")
        total = reference.agg(F.count("*").alias("rows"))  # one row
        counts = cells(reference, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
        values = counts.join(F.broadcast(total)).select("column", "value", "n", (n / F.col("rows")).alias("frequency"), C.number_with_unit(v)["x"].alias("x"), C.is_blank(v).alias("blank"))
        self.values = written(values, "cell-values")
        some = F.when(~F.col("blank"), n).otherwise(0)
        stat = self.values.groupBy("column").agg(F.count("*").alias("k"), (F.sum(F.when(F.col("x").isNotNull(), some).otherwise(0)) / F.nullif(F.sum(some), F.lit(0))).alias("numbers"))
        q = quantiles(self.values.where("x is not null"), ["column"], "x", [0.25, 0.5, 0.75], "n")
        kind = F.when(F.coalesce("numbers", F.lit(0.0)) >= 0.8, "numeric").when(F.col("k") <= max_categories, "categorical").otherwise("text")
        median, scale = F.coalesce(F.col("q")[1], F.lit(0.0)), F.greatest(F.coalesce(F.col("q")[2] - F.col("q")[0], F.lit(1.0)), F.lit(1e-3))
        #: column, kind, median, scale, classes: one row for each column.
        self.specs = written(stat.join(q, "column", "left").select("column", kind.alias("kind"), median.alias("median"), scale.alias("scale"), F.when(kind == "categorical", F.col("k")).otherwise(0).alias("classes")), "cell-specs")
        few = self.values.join(F.broadcast(self.specs.where("kind = 'categorical'").select("column")), "column")  # one row for each column
        self.labels = few.select("column", "value", F.row_number().over(W.partitionBy("column").orderBy(F.asc_nulls_last("value"))).alias("label"))  # at most max_categories for each

    def encode(self, long: DataFrame) -> DataFrame:
        """long (column, value and more columns) with kind, label (0: unknown) and features."""
        v = F.col("value")
        distinct = long.select("column", "value").distinct().join(F.broadcast(self.specs), "column")  # one row for each column
        same = lambda a, b: (a["column"] == b["column"]) & a["value"].eqNullSafe(b["value"])
        often = self.values.select("column", "value", "frequency")
        rows = distinct.join(often, same(distinct, often), "left").select(distinct["*"], F.coalesce("frequency", F.lit(0.0)).alias("frequency"))
        rows = rows.join(self.labels, same(rows, self.labels), "left").select(rows["*"], F.coalesce("label", F.lit(0)).alias("label"))
        number = C.number_with_unit(v)
        scaled = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (number["x"] - F.col("median")) / F.col("scale")))
        rows = rows.withColumn("_number", F.when(number.isNotNull(), scaled).otherwise(0.0)).withColumn("_unit", F.coalesce((number["unit"] != "").cast("double"), F.lit(0.0))).withColumn("_text", lexical(F.coalesce(v, F.lit(""))))
        features = F.concat(F.array("_number"), F.slice("_text", 2, 7), F.array("frequency", "_unit"), F.slice("_text", 11, FEATURES - 10))
        if self.vectors is not None:
            rows = rows.join(self.vectors.select(F.col("value").alias("_value"), "vector"), F.col("value") == F.col("_value"), "left")
            features = F.concat(features, F.coalesce("vector", F.array().cast("array<double>")))
        rows = rows.select("column", "value", "kind", "label", features.alias("features"))
        return long.join(rows, same(long, rows)).select(long["*"], "kind", "label", "features")

    def transform(self, df: DataFrame) -> DataFrame:
        """row_id, column, value, kind, label and features of every cell of df."""
        return self.encode(cells(df, self.columns))


def synthetic_value(v: Column, scale: Column) -> Column:
    """A value that can't be right: a number ten scales further, other texts with a mark at their end."""
    n = C.number_with_unit(v)
    moved = F.concat((n["x"] + 10 * scale).cast("string"), F.when(n["unit"] != "", F.concat(F.lit(" "), n["unit"])).otherwise(""))
    return F.coalesce(moved, F.concat(v, F.lit("#?~")))

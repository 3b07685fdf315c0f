"""A store of vectors of texts, addressed by what they are: each distinct text is embedded once, whatever table it comes from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.plans.tables import share_package

Embed = Callable[[list[str]], "list[list[float]]"]
STORED = "key string, value string, vector array<double>"


class SemanticStore:
    """Vectors by SHA-256 of the text, in one folder for each model.

    load: makes the embedding function, once for each task; it raises where the model is missing, and nothing is put in its place. model: names the
    model and its version; vectors of another one are never read. Vectors are appended as they are made, so a run that fails
    keeps what was written before it.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str, load: Callable[[], Embed], batch: int = 256):
        if not model or "/" in model:
            raise ValueError("a store needs the name of a model")
        self.spark, self.path, self.load, self.batch = spark, f"{folder.rstrip('/')}/model={model}", load, batch
        share_package(spark)

    def stored(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.path).dropDuplicates(["key"])  # two runs may have made the same one

    def add(self, texts: DataFrame) -> None:
        """Embed the distinct texts (column value) that the store doesn't hold, in Arrow batches."""
        load, batch = self.load, self.batch
        new = texts.where("value is not null").select("value").distinct().withColumn("key", F.sha2("value", 256)).join(self.stored().select("key"), "key", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            embed, wide = None, None
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    embed = embed or load()
                    made = [[float(x) for x in v] for v in embed(part.column("value").to_pylist())]
                    wide = wide or len(made[0])
                    if len(made) != part.num_rows or any(len(v) != wide for v in made):
                        raise ValueError("the model must give one vector of one length for each text")
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("value"), pa.array(made, pa.list_(pa.float64()))], ["key", "value", "vector"])

        new.select("key", "value").mapInArrow(run, STORED).write.mode("append").parquet(self.path)

    def vectors(self, texts: DataFrame) -> DataFrame:
        """value and vector of each distinct text."""
        self.add(texts)
        wanted = texts.where("value is not null").select("value").distinct().withColumn("key", F.sha2("value", 256))
        return wanted.join(self.stored().select("key", "vector"), "key").select("value", "vector")

"""Reading dirty tables and writing findings."""

from __future__ import annotations

import contextlib
import csv
import fcntl
import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_TRUE, MASK_FALSE = ("true", "1", "yes", "t"), ("false", "0", "no", "f")


def with_row_ids(df: DataFrame, key: str | None = None) -> DataFrame:
    """row_id: a natural key if one is named, else the place in the table, counted by partition so that no task counts all.

    Places need a table that reads in the same order again, as files do. Only the numbers of rows come to the driver.
    """
    if key is not None:
        return df.withColumnRenamed(key, "row_id")
    spark = df.sparkSession
    at = F.monotonically_increasing_id()  # the partition from bit 33 on, below it the place in it
    tagged = df.select(F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"), F.struct("*").alias("_row"))
    counts = {r["_part"]: r["count"] for r in tagged.groupBy("_part").count().collect()}
    begin, starts = 0, []
    for part in sorted(counts):
        starts.append((part, begin))
        begin += counts[part]
    known = spark.createDataFrame(starts, "_part int, _begin long")  # one row for each partition
    return tagged.join(F.broadcast(known), "_part").select((F.col("_begin") + F.col("_place")).alias("row_id"), "_row.*")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV file's first line, as they stand there."""
    line = spark.read.text(path).first()
    return [] if line is None else next(csv.reader([re.sub("^\ufeff", "", line[0])]), [])


def read_csv(spark: SparkSession, path: str, keep_empty: bool = False, key: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as strings, with row_id. Empty cells are null; keep_empty: empty strings, and the header must name
    each column once, and the table must have rows. Without multi_line a cell can't hold a line break, and files can be split."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False)
    df = reader.csv(path)
    if keep_empty:
        head = header_of(spark, path)
        if not head or not all(head) or len(set(head)) < len(head):
            raise ValueError("the header must name each column once")
        df = df.toDF(*head).na.fill("")
        if df.isEmpty():
            raise ValueError("the table has no rows")
    return with_row_ids(df, key)


def as_text(df: DataFrame, key: str) -> DataFrame:
    """A typed table as one of strings, with its key as row_id."""
    return df.select(F.col(key).alias("row_id"), *(F.col(c).cast("string").alias(c) for c in df.columns if c != key))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """The dirty cells (row_id, column) of a wide mask file: cells that say false; what can't be read is clean."""
    wide = read_csv(spark, path)
    long = wide.unpivot(["row_id"], [c for c in wide.columns if c != "row_id"], "column", "value")
    return long.where(F.lower(F.trim("value")).isin(*MASK_FALSE)).select("row_id", "column")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """row_id, column, is_error, confidence, fix: unknown truth values are false, confidences clipped to [0, 1]."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    fix = F.col("suggested_fix") if "suggested_fix" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.col("row_id").try_cast("long").alias("row_id"), "column", F.lower(F.trim("is_error")).isin(*MASK_TRUE).alias("is_error"), sure.alias("confidence"), fix.alias("fix"))


def read_semantic_types(spark: SparkSession, path: str) -> dict[str, str]:
    """column -> semantic type, of a JSON array of rules; nothing if the file isn't there."""
    try:
        rows = spark.read.option("multiLine", True).schema("column string, semantic_type string").json(path)
        return {r["column"]: r["semantic_type"] for r in rows.where("column is not null").collect()}
    except Exception as e:  # Spark names a missing path so
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def write_findings(findings: DataFrame, path: str, form: str = "csv") -> None:
    writer = findings.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if form == "csv" else writer.format(form).save(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """One JSON object for each column."""
    profile.write.mode("overwrite").json(path)


def dense_detections(df: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each cell: the decision, or that there is none, with all its evidence as JSON."""
    columns = [c for c in df.columns if c != "row_id"]
    cells = df.select("row_id", *(F.col(c).cast("string") for c in columns)).unpivot(["row_id"], columns, "column", "value")
    lists = evidence.where("status <> 'abstain'").groupBy("row_id", "column").agg(F.to_json(F.array_sort(F.collect_list(F.struct("constraint_id", "family", "status", "score", "reliability")))).alias("evidence"))
    out = cells.join(decisions, ["row_id", "column"], "left").join(lists, ["row_id", "column"], "left")
    return out.na.fill({"is_error": False, "error_score": 0.0, "error_type": "NONE", "low_confidence": False, "evidence": "[]"})


def fingerprint(value: Any) -> str:
    """SHA-256 of the value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def write_json(path: str, value: Any) -> None:
    """All of the file or nothing of it: a new file takes the old one's place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    with os.fdopen(fd, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, sort_keys=True, indent=1)
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, target)


@contextlib.contextmanager
def run_lock(path: str) -> Iterator[None]:
    """One driver at a time; raises BlockingIOError if another has the lock."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class AnswerCache:
    """Answers of an external service by the hash of what was asked, for one version of the question's wording."""

    def __init__(self, path: str, version: str = "", flush_every: int = 50):
        self.path, self.version, self.flush_every, self.new = Path(path), version, flush_every, 0
        self.data: dict[str, Any] = json.loads(self.path.read_text()) if self.path.exists() else {}

    @staticmethod
    def key(question: Any) -> str:
        return hashlib.md5(json.dumps(question, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def get(self, question: Any) -> Any:
        found = self.data.get(self.key(question))
        return None if found is None or found.get("_v", self.version) != self.version else found["answer"]

    def set(self, question: Any, answer: Any) -> None:
        self.data[self.key(question)] = {"_v": self.version, "answer": answer}
        self.new += 1
        if self.new >= self.flush_every:
            self.flush()

    def flush(self) -> None:
        write_json(str(self.path), self.data)
        self.new = 0


def dataset_paths(dirty_csv: str, root: str = "outputs") -> dict[str, str]:
    """The usual places of a dataset's files, named after {name}_dirty.csv."""
    name = re.sub(r"_dirty$", "", Path(dirty_csv).stem)
    base = Path(root) / name
    kinds = {"errors": "errors", "rules": "rules.json", "profile": "profile", "mask": "clean_mask", "candidates": "candidates", "fused": "fused", "judgments": "judgments", "final": "final", "rule_cache": "cache/rules.json", "answer_cache": "cache/answers.json"}
    return {"name": name, "dirty": dirty_csv, "clean": str(Path(dirty_csv).with_name(f"{name}_clean.csv"))} | {k: str(base / v) for k, v in kinds.items()}


def backup(paths: list[str], to: str) -> list[str]:
    """Copies of the files and folders that exist."""
    out = []
    Path(to).mkdir(parents=True, exist_ok=True)
    for p in map(Path, paths):
        if p.exists():
            target = Path(to) / p.name
            shutil.copytree(p, target, dirs_exist_ok=True) if p.is_dir() else shutil.copy2(p, target)
            out.append(str(target))
    return out

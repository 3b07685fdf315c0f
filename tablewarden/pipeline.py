"""The whole chain on one table: findings, mask, candidates, fused cells, verdicts."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators import anomalies, denial, dependencies, detectors, discovery, fusion, models, profile, rules
from tablewarden.plans.tables import written
from tablewarden.sources import tables


FINDING_COLUMNS = ("row_id", "column", "value", "error_type", "rule", "suggested_fix", "confidence", "severity")


@dataclass(frozen=True)
class Options:
    rules: list[rules.Rule] = field(default_factory=list)
    nullable: frozenset[str] = frozenset()
    statistical: bool = True
    model: bool = True
    min_tier: str = "low"
    as_of_year: int | None = None  # years beyond the next one are errors; none: years aren't checked


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    dirty: DataFrame
    candidates: DataFrame
    fused: DataFrame
    final: DataFrame


def run(df: DataFrame, options: Options = Options(), judgments: DataFrame | None = None) -> Result:
    """df: strings and row_id. Judgments of an outside arbiter (row_id, column, is_error, confidence, fix) are optional."""
    columns = [c for c in df.columns if c != "row_id"]
    kinds = {r["column"]: r["kind"] for r in profile.kinds(df).collect()}
    chain = [detectors.missing(df, options.nullable)]
    if options.rules:
        broken = rules.first_violations(df, rules.gated(df, options.rules), frozenset(columns))
        chain.append(broken.select("*", F.lit(None).cast("string").alias("suggested_fix"), F.lit(None).cast("double").alias("confidence"), F.lit("high").alias("severity")))
    chain += [detectors.disguised_missing(df), detectors.leaked(df, columns), detectors.repeated_values(df)]
    chain += [detectors.out_of_range(df, c) for c in columns if kinds.get(c) == "numeric" and detectors.bounds_of(c)]
    grouped = [c for c in columns if kinds.get(c) in ("categorical", "id", "numeric")]
    between = []
    if len(grouped) > 1:
        between.append(dependencies.graded_violations(df, grouped))
        few = [c for c in columns if kinds.get(c) == "categorical"]
        if few:
            between.append(dependencies.constant_violations(df, few, grouped))
    between.append(denial.denial_findings(df, columns, options.as_of_year))
    named = lambda f, i: f.select(*FINDING_COLUMNS).withColumn("place", F.concat_ws("|", F.lit(i), "rule"))
    chain.append(dependencies.resolve_conflicts(reduce(DataFrame.unionByName, (named(f, i) for i, f in enumerate(between)))).select(*FINDING_COLUMNS))
    findings = written(detectors.first_of_each_cell(chain), "findings")
    dirty = detectors.dirty_cells(findings)
    found = []
    if options.statistical:
        clean = df.select("row_id").join(dirty.select("row_id"), "row_id", "left_anti")
        found += [anomalies.outliers(df, c, clean) for c in columns if kinds.get(c) == "numeric"]
        found += [anomalies.typos(df, c, dirty) for c in columns if kinds.get(c) == "categorical"]
        dated = set(discovery.date_columns(df, columns)) - {c for c in columns if kinds.get(c) == "empty"}
        found += [anomalies.odd_patterns(df, c, dates=c in dated) for c in columns if kinds.get(c) not in ("numeric", "empty")]
        found += [f for c in sorted(dated) for f in (anomalies.secondary_formats(df, c), anomalies.bursts(df, c, dates=True))]
        found += [anomalies.outliers(df, c, clean, dates=True) for c in sorted(dated) if kinds.get(c) in ("categorical", "highcard")]
        found += [anomalies.odd_number_counts(df, c) for c in columns if kinds.get(c) == "numeric"]
    if options.model and len(grouped) > 1:
        found.append(models.unlikely_cells(models.predictions(df, grouped, dirty), dirty))
    evidence = fusion.as_evidence(findings)
    for f in found:
        evidence = evidence.unionByName(f.select(*evidence.columns))
    evidence = written(evidence, "evidence")
    fused = written(fusion.of_tier(fusion.fused(fusion.normalised(evidence)), options.min_tier), "fused")
    final = fusion.propagated_fixes(fusion.judged(fused, judgments)).where("is_error")
    return Result(findings, dirty, evidence, fused, final)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Find errors in the cells of a CSV table.")
    parser.add_argument("input")
    parser.add_argument("--output", default="outputs")
    parser.add_argument("--min-tier", choices=("low", "mid", "high"), default="low")
    parser.add_argument("--no-model", action="store_true")
    parser.add_argument("--no-statistical", action="store_true")
    parser.add_argument("--nullable", nargs="*", default=[], metavar="COLUMN", help="columns in which blanks are allowed")
    parser.add_argument("--as-of-year", type=int, help="check years against this one")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tablewarden").getOrCreate()
    paths = tables.dataset_paths(args.input, args.output)
    df = tables.read_csv(spark, args.input)
    result = run(df, Options(model=not args.no_model, statistical=not args.no_statistical, min_tier=args.min_tier, nullable=frozenset(args.nullable), as_of_year=args.as_of_year))
    tables.write_findings(result.findings, paths["errors"])
    tables.write_findings(result.fused, paths["fused"])
    tables.write_findings(result.final, paths["final"])
    tables.write_profile(profile.profile(df), paths["profile"])


if __name__ == "__main__":
    main()

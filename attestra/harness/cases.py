"""Cases of rules in folders: scope/rule/positive or negative/number, each with data and expected results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.harness.score import changes, score, scoreboard
from attestra.plans.engine import Knowledge, validate
from attestra.plans.rules import load_rules
from attestra.sources.tables import scan_folder

EXPECTED = "rule_id string, dataset string, domain string, row int, variables string, message string, error_count int, usubjid string, seq string"


@dataclass(frozen=True)
class Case:
    scope: str
    rule: str
    kind: str  # positive or negative
    number: str
    folder: Path

    @property
    def name(self) -> str:
        return f"{self.scope}/{self.rule}/{self.kind}/{self.number}"


def discover(root: str | Path) -> list[Case]:
    """All cases in name order; a case is a numbered folder with a data folder."""
    found = []
    for folder in sorted(Path(root).glob("*/*/*/*")):
        scope, rule, kind, number = folder.parts[-4:]
        if kind in ("positive", "negative") and (folder / "data").is_dir():
            found.append(Case(scope, rule, kind, number, folder))
    return found


def expected(spark: SparkSession, case: Case) -> DataFrame:
    """The case's expected issues; a case without a file expects none."""
    path = case.folder / "results" / "results.csv"
    if not path.exists():
        return spark.createDataFrame([], EXPECTED).withColumn("variables", F.split("variables", r"\|"))
    return spark.read.csv(str(path), header=True, schema=EXPECTED).withColumn("variables", F.split("variables", r"\|")).where("row IS NOT NULL OR variables IS NOT NULL")


def run_case(spark: SparkSession, case: Case, knowledge: Knowledge | None = None) -> tuple[DataFrame, bool]:
    """The issues of the case's rule on its data, and whether the rule ran."""
    files = [p for p in case.folder.parent.parent.iterdir() if p.suffix in (".json", ".yaml", ".yml")]
    tables, _ = scan_folder(spark, str(case.folder / "data"))
    report = validate(spark, load_rules(files), tables, knowledge)
    return report.issues, any(r.status != "skipped" for r in report.results)


def run_scored(spark: SparkSession, root: str | Path, knowledge: Knowledge | None = None) -> DataFrame:
    """(rule_id, bucket, found, expected): one row for each case, whose name stands as its rule id."""
    got, wanted, ran = None, None, []
    for case in discover(root):
        issues, was_run = run_case(spark, case, knowledge)
        named = lambda df, c=case: df.withColumn("rule_id", F.lit(c.name)).select("rule_id", "dataset", "row", "variables", "usubjid", "seq")
        got = named(issues) if got is None else got.unionByName(named(issues))
        wanted = named(expected(spark, case)) if wanted is None else wanted.unionByName(named(expected(spark, case)))
        ran.append((case.name, was_run))
    if got is None:
        raise ValueError(f"no cases in {root}")
    return score(got, wanted, spark.createDataFrame(ran, "rule_id string, ran boolean"))


def gate(scores: DataFrame, baseline: DataFrame, good: Sequence[str] = ("match", "empty_match")) -> Iterator[str]:
    """What is worse than in the baseline: cases that were good and are not."""
    for r in changes(baseline, scores).where(F.col("before").isin(*good)).collect():
        yield f"{r['rule_id']}: {r['before']} became {r['after']}"


def markdown(scores: DataFrame) -> str:
    lines = ["| bucket | cases | share |", "|-|-|-|"]
    lines += [f"| {r['bucket']} | {r['rules']} | {r['share']:.2%} |" for r in scoreboard(scores).orderBy("bucket").collect()]
    return "\n".join(lines) + "\n"

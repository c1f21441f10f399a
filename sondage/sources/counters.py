"""What a query has read: Spark's own metrics of its scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row


@dataclass(frozen=True)
class Reads:
    """Files and bytes that scans opened, and rows that left them after skipping row groups; `scans` counts the scans, a reused one once."""

    scans: int = 0
    files: int = 0
    bytes: int = 0
    rows: int = 0


def collect_counted(df: DataFrame) -> tuple[list[Row], Reads]:
    """The rows of a result and what was read for them. Each call counts anew; for results that fit on the driver."""
    rows = df.collect()
    scans, done = [], set()

    def visit(node) -> None:
        name = node.getClass().getSimpleName()
        if node.id() in done:
            return
        done.add(node.id())
        if name == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            visit(node.plan())
        elif name == "FileSourceScanExec":
            scans.append(node)
        else:
            children = node.children()
            for i in range(children.size()):
                visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())

    def total(metric: str) -> int:
        found = [s.metrics().get(metric) for s in scans]
        return sum(m.get().value() for m in found if m.isDefined())

    return rows, Reads(len(scans), total("numFiles"), total("filesSize"), total("numOutputRows"))

"""Query profiles from Spark's own tracker and metrics."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

PHASES = ("parsing", "analysis", "optimization", "planning")


@dataclass
class Node:
    name: str
    metrics: dict[str, int] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)
    depth: int = 0

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def rows(self) -> int | None:
        return self.metrics.get("numOutputRows")

    def filter_stats(self) -> dict | None:
        """Input, output and selectivity of a filter: its input is the first count below it."""
        if not self.name.startswith("Filter") or self.rows is None:
            return None
        below = next((n.rows for c in self.children for n in c.walk() if n.rows is not None), None)
        if below is None:
            return None
        return {"input_rows": below, "output_rows": self.rows, "filtered": below - self.rows, "selectivity": self.rows / below if below else 0.0}


@dataclass
class Profile:
    phases_ms: dict[str, float]
    execution_ms: float
    row_count: int
    tree: Node
    summary: dict

    @property
    def total_ms(self) -> float:
        return sum(self.phases_ms.values()) + self.execution_ms


def _node(plan, depth: int = 0) -> Node:
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _node(plan.executedPlan(), depth)
    if kind.endswith("QueryStageExec"):
        return _node(plan.plan(), depth)
    found, it = {}, plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        found[pair._1()] = pair._2().value()
    node, children = Node(plan.nodeName(), found, [], depth), plan.children().iterator()
    while children.hasNext():
        node.children.append(_node(children.next(), depth + 1))
    return node


def bottlenecks(tree: Node) -> dict:
    """The slowest operator, the one with most rows, bytes spilled and overall selectivity."""
    timed = [(n.metrics.get("scanTime", 0) + n.metrics.get("sortTime", 0) + n.metrics.get("aggTime", 0) + n.metrics.get("pipelineTime", 0), n.name) for n in tree.walk()]
    counted = [(n.rows or 0, n.name) for n in tree.walk()]
    slow, large = max(timed), max(counted)
    leaves = [n.rows or 0 for n in tree.walk() if not n.children]
    out = next((n.rows for n in tree.walk() if n.rows is not None), 0)
    return {
        "slowest": slow[1], "slowest_ms": slow[0], "largest": large[1], "total_rows_processed": large[0],
        "spilled_bytes": sum(n.metrics.get("spillSize", 0) for n in tree.walk()), "selectivity": out / sum(leaves) if sum(leaves) else 0.0,
    }


def profile(df: DataFrame | str, spark: SparkSession | None = None) -> Profile:
    """Run all partitions of a query (without bringing rows to the driver) and read its phases and metrics."""
    if isinstance(df, str):
        df = spark.sql(df)
    execution = df._jdf.queryExecution()
    execution.executedPlan()
    phases, it = {}, execution.tracker().phases().iterator()
    while it.hasNext():
        pair = it.next()
        phases[pair._1()] = float(pair._2().durationMs())
    began = time.perf_counter()
    rows = _drain(df)
    took = (time.perf_counter() - began) * 1000
    tree = _node(execution.executedPlan())
    return Profile({p: phases.get(p, 0.0) for p in PHASES}, took, rows, tree, bottlenecks(tree))


def _drain(df: DataFrame) -> int:
    """Run the very plan whose metrics are read; only counts leave the executors."""
    return df._jdf.queryExecution().toRdd().count()


def report(p: Profile) -> str:
    """A text tree with phases, rows and bottlenecks."""
    lines = [f"{k:<13}{v:10.1f} ms" for k, v in p.phases_ms.items()] + [f"{'execution':<13}{p.execution_ms:10.1f} ms", f"rows {p.row_count}", ""]
    for n in p.tree.walk():
        rows = "" if n.rows is None else f"  rows={n.rows}"
        f = n.filter_stats()
        lines.append("  " * n.depth + n.name + rows + (f"  selectivity={f['selectivity']:.3f}" if f else ""))
    return "\n".join([*lines, "", *(f"{k}: {v}" for k, v in p.summary.items())])


def format_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def compare(a: Profile, b: Profile) -> dict[str, dict[str, float]]:
    """Ratio b / a (0 where a is 0) and difference for every phase, execution and total."""
    pairs = {k: (a.phases_ms[k], b.phases_ms[k]) for k in PHASES} | {"execution": (a.execution_ms, b.execution_ms), "total": (a.total_ms, b.total_ms)}
    return {k: {"ratio": y / x if x else 0.0, "difference_ms": y - x} for k, (x, y) in pairs.items()}


def export_json(p: Profile) -> str:
    return json.dumps({"phases_ms": p.phases_ms, "execution_ms": p.execution_ms, "total_ms": p.total_ms, "row_count": p.row_count, "summary": p.summary}, indent=1)


def export_text(p: Profile, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(report(p))


class MetricsScope:
    """Scan metrics of one query, or summed over a session; the mode is part of each name."""

    SUFFIX = {"scan": "_this_scan", "session": "_session_total"}

    def __init__(self, mode: str = "scan"):
        if mode not in self.SUFFIX:
            raise ValueError(f"unknown mode: {mode}")
        self.mode, self.total = mode, {}

    def read(self, p: Profile) -> dict[str, int]:
        now: dict[str, int] = {}
        for n in p.tree.walk():
            if n.name.startswith("Scan"):
                for k in ("numOutputRows", "numFiles", "filesSize"):
                    now[k] = now.get(k, 0) + n.metrics.get(k, 0)
        for k, v in now.items():
            self.total[k] = self.total.get(k, 0) + v
        return {k + self.SUFFIX[self.mode]: v for k, v in (now if self.mode == "scan" else self.total).items()}


def as_dict(p: Profile) -> dict:
    return asdict(p)

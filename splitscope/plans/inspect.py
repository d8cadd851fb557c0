"""Plan inspection helpers: executed-plan text, scan counts, what feeds each window.

Used by tests and the bench to keep plans honest (one scan where a report reads
one table many times, no Python evaluation, windows only above aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def executed_plan(df: DataFrame) -> str:
    """Physical plan as text (formatted mode, AQE initial plan)."""
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def _nodes(df: DataFrame):
    """Yield (node, parents-chain) over the executed plan, AQE subplans expanded."""
    root = df._jdf.queryExecution().executedPlan()  # noqa: SLF001

    def children(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return [node.executedPlan()]
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage"):
            return [node.plan()]
        if name == "ReusedExchange":
            return []
        kids = node.children()
        return [kids.apply(i) for i in range(kids.size())]

    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(children(n))


def scan_count(df: DataFrame) -> int:
    """Number of file-scan leaves in the physical plan."""
    return sum(1 for n in _nodes(df) if n.nodeName().startswith("Scan") or n.nodeName() == "FileSourceScanExec")


def exchange_count(df: DataFrame) -> int:
    """Number of shuffle exchanges (hash, range, single-partition) in the physical plan."""
    return sum(1 for n in _nodes(df) if n.nodeName() in ("Exchange", "ShuffleExchange"))


def aggregate_inputs(df: DataFrame, name: str) -> list[str]:
    """For each aggregate node of that name, the names of the nodes below it, down to the next join or aggregate."""
    out = []
    for n in _nodes(df):
        if n.nodeName() != name:
            continue
        names, cur = [], n
        while cur.children().size():
            cur = cur.children().apply(0)
            names.append(cur.nodeName())
            if "Join" in names[-1] or "Aggregate" in names[-1]:
                break
        out.append(" > ".join(names))
    return out


def window_inputs(df: DataFrame) -> list[str]:
    """For each Window node, the node names below it down to the first exchange or aggregate."""
    out = []
    for n in _nodes(df):
        if n.nodeName() != "Window":
            continue
        names = []
        cur = n
        for _ in range(12):
            kids = cur.children()
            if kids.size() == 0:
                break
            cur = kids.apply(0)
            names.append(cur.nodeName())
            if "Aggregate" in cur.nodeName() or cur.nodeName() in ("Union",):
                break
            if cur.nodeName() in ("Exchange", "ShuffleExchange", "ShuffleQueryStage", "AQEShuffleRead"):
                if cur.nodeName() == "ShuffleQueryStage":
                    cur = cur.plan()
                continue
        out.append(" > ".join(names))
    return out

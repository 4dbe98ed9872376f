"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by their membership pattern, the set of sources they belong to. For each mix
a flow network sends token capacity from patterns to source quotas (target share times budget): the
r-th pass over a pattern's tokens costs r - 1 a token, so the cost of repeating is convex and nothing
is repeated before everything was used once; a quota's uncovered rest is routed over an edge dearer
than any repetition and is reported as shortage. The network has one node a pattern and a source,
whatever the number of documents.

The flow of a pattern is then laid over its documents in the order of a seeded hash: copies of the
pattern's token line are put end to end, each source owns a stretch of its flow's length, and a
document is chosen once for every copy of it that begins in the stretch. Positions on the line come
from tokens per hash bucket and running sums inside buckets, so no task sees a whole pattern.

Edge cases: null texts have 0 tokens and are never chosen; documents with a null source belong to no
pattern but count in the budget; repeated ids count as separate rows (fold them first); a source without
documents has a shortage of its whole quota; targets of null, 0 or less ask for nothing; empty tables
give empty results. ``max_repeats`` of 1 or less (or null) means once.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauselake.llm.tokens import with_tokens
from clauselake.session import written

_BUCKETS = 4096


class Network:
    """Min-cost flow by successive shortest paths with potentials; capacities are tokens."""

    def __init__(self) -> None:
        self.edges: list[list[float]] = []  # to, left, cost; the reverse edge follows
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, capacity: float, cost: float) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0.0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int, eps: float = 1e-6) -> None:
        n = len(self.out)
        high = [0.0] * n
        while True:
            dist, via = [float("inf")] * n, [-1] * n
            dist[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u] + 1e-12:
                    continue
                for e in self.out[u]:
                    v, left, cost = self.edges[e]
                    nd = d + cost + high[u] - high[v]
                    if left > eps and nd < dist[v] - 1e-9:
                        dist[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
            if via[sink] < 0:
                return
            high = [h + (d if d < float("inf") else 0.0) for h, d in zip(high, dist)]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.edges[via[v] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount

    def flow(self, e: int) -> float:
        return self.edges[e ^ 1][1]


def plan_mix(patterns: dict[tuple[str, ...], int], targets: Sequence[Row], total: int) -> tuple[list[tuple], list[tuple]]:
    """targets of one mix: rows (source, target_share, max_repeats, budget_ratio).

    Returns flows (pattern, source, tokens) and results (source, quota, shortage, capacity)."""
    net = Network()
    start, end = net.node(), net.node()
    wanted = {t.source: t for t in sorted(targets, key=lambda t: str(t.source)) if t.source is not None}
    quota = {s: max(0.0, (t.target_share or 0.0) * (t.budget_ratio or 0.0) * total) for s, t in wanted.items()}
    times = {s: max(1, t.max_repeats or 1) for s, t in wanted.items()}
    source = {s: net.node() for s in wanted}
    dear = 2.0 + max(times.values(), default=1)
    short = {}
    for s, q in quota.items():
        net.edge(source[s], end, q, 0)
        short[s] = net.edge(start, source[s], q, dear)
    sent = []
    for p, size in sorted(patterns.items()):
        members = [s for s in p if s in wanted]
        if not members or not size:
            continue
        a, b = net.node(), net.node()
        most = max(times[s] for s in members)
        net.edge(start, a, float(size) * most, 0)
        for r in range(most):
            net.edge(a, b, float(size), float(r))
        sent += [(p, s, net.edge(b, source[s], float(size) * times[s], 0)) for s in members]
    net.run(start, end)
    flows = [(p, s, net.flow(e)) for p, s, e in sent if net.flow(e) > 1e-6]
    capacity = {s: float(times[s]) * sum(size for p, size in patterns.items() if s in p) for s in wanted}
    return flows, [(s, quota[s], net.flow(short[s]), capacity[s]) for s in wanted]


class Mixer:
    """Token counts of documents by pattern; plans and selections for the mixes of a target table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, sources, targets: DataFrame, *, seed: int = 17, tokenizer_path: str | None = None, tokenizer_pattern: str | None = None, max_patterns: int = 100_000):
        """sources: a column of one source or of an array of sources. Raises if more than max_patterns combinations of them occur."""
        spark = docs.sparkSession
        self.seed, self.targets = seed, targets
        kind = dict(docs.select(F.col(sources).alias("s")).dtypes)["s"]
        member = F.col(sources) if kind.startswith("array") else F.array(F.col(sources))
        pattern = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(member, F.array().cast("array<string>")))))
        rows = docs.select(F.col(id_col).alias("id"), pattern.alias("pattern"), F.col(text_col).alias("text"))
        self.docs = written(with_tokens(rows, "text", tokenizer_path, tokenizer_pattern), "tokens")
        sums = self.docs.groupBy("pattern").agg(F.sum("n_tokens").alias("n"))
        got = sums.limit(max_patterns + 1).collect()  # a row for each combination of sources that occurs
        if len(got) > max_patterns:
            raise ValueError(f"more than {max_patterns} combinations of sources: too many for one flow network")
        self.patterns = {tuple(r.pattern): r.n or 0 for r in got if r.pattern}
        self.total = sum(r.n or 0 for r in got)
        by: dict[str, list[Row]] = {}
        for t in targets.select("mix_name", "source", "target_share", "max_repeats", "budget_ratio").distinct().collect():  # the configuration
            by.setdefault(t.mix_name, []).append(t)
        flows, found = [], []
        for mix, rows_ in sorted(by.items(), key=lambda x: str(x[0])):
            f, r = plan_mix(self.patterns, rows_, self.total)
            offset: dict[tuple[str, ...], float] = {}
            for p, s, n in f:
                lo = offset.get(p, 0.0)
                offset[p] = lo + n
                flows.append((mix, list(p), s, lo, lo + n, float(self.patterns[p])))
            budget = float(max((t.budget_ratio or 0.0) for t in rows_) * self.total)
            found += [(mix, *x, budget) for x in r]
        self.flows = spark.createDataFrame(flows, "mix_name string, pattern array<string>, source string, lo double, hi double, size double")
        self.results = spark.createDataFrame(found, "mix_name string, source string, quota double, shortage double, capacity double, budget double")

    def shortages(self) -> DataFrame:
        """(mix_name, source) of sources that cannot cover their quota with all repetitions."""
        return self.results.where((F.col("shortage") > 1e-9 * F.col("quota")) & (F.col("quota") > 0)).select("mix_name", "source", "quota", "shortage")

    def selection(self) -> DataFrame:
        """(mix_name, source, id, repeats, n_tokens): the chosen documents with their repeat counts."""
        h = F.xxhash64(F.col("id").cast("string"), F.lit(self.seed))
        d = self.docs.where("n_tokens > 0 AND size(pattern) > 0").withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)).cast("int"))
        sums = d.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
        before = sums.select("pattern", "bucket", (F.sum("n").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("base"))  # at most 4 096 rows a pattern
        inside = W.partitionBy("pattern", "bucket").orderBy("h", F.col("id").cast("string")).rowsBetween(W.unboundedPreceding, -1)
        at = d.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["pattern", "bucket"])
        c = (F.col("base") + F.col("inner")).cast("double")
        picked = at.join(F.broadcast(self.flows), "pattern")  # flows: patterns times sources, from the plan
        copies = F.ceil((F.col("hi") - c) / F.col("size")) - F.greatest(F.ceil((F.col("lo") - c) / F.col("size")), F.lit(0))
        return picked.withColumn("repeats", copies.cast("int")).where("repeats > 0").select("mix_name", "source", "id", "repeats", "n_tokens")

    def shares(self) -> DataFrame:
        """(mix_name, source, target_tokens, actual_tokens, most_repeats, budget_share, actual_share) from the selection:
        shares of the budget, as target_share is, and of all chosen tokens of the mix."""
        got = self.selection().groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.max("repeats").alias("most_repeats"))
        r = self.results.select("mix_name", "source", "budget", F.col("quota").alias("target_tokens")).join(F.broadcast(got), ["mix_name", "source"], "left").na.fill(0, ["actual_tokens", "most_repeats"])
        whole = F.sum("actual_tokens").over(W.partitionBy("mix_name"))
        share = lambda of: F.when(of > 0, F.col("actual_tokens") / of).otherwise(0.0)
        return r.withColumn("budget_share", share(F.col("budget"))).withColumn("actual_share", share(whole)).drop("budget")

    def limits(self) -> DataFrame:
        """(mix_name, source, repeats_ok, share_ok): is nothing repeated more often than allowed, and do the chosen tokens differ from the planned flow by no more than one document for each pattern?"""
        single = self.docs.select(F.explode("pattern").alias("source"), "pattern", "n_tokens").groupBy("source").agg(F.max("n_tokens").alias("largest"), F.count_distinct("pattern").alias("n_patterns"))
        plan = self.results.select("mix_name", "source", (F.col("quota") - F.col("shortage")).alias("flow"))
        asked = self.targets.groupBy("mix_name", "source").agg(F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("allowed"))
        got = self.shares().select("mix_name", "source", "actual_tokens", "most_repeats").join(plan, ["mix_name", "source"]).join(asked, ["mix_name", "source"]).join(single, "source", "left")
        off = F.abs(F.col("actual_tokens") - F.col("flow")) <= F.coalesce(F.col("largest") * F.col("n_patterns"), F.lit(0)) + 1
        return got.select("mix_name", "source", (F.col("most_repeats") <= F.col("allowed")).alias("repeats_ok"), off.alias("share_ok"))

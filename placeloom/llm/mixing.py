"""Sources mixed to target shares of tokens, small ones repeated up to a limit, overlapping ones shared out.

Texts are summed up by the set of sources they occur in. A min-cost flow over those sums, a few
nodes however large the corpus, says how many tokens of each set go to each source; the more often a
text is used, the dearer the next use. Texts are then laid on a tape in seeded order, each set's tape
repeated as often as needed, and every source takes its stretch of it.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.bpe import VOCABULARY, token_counts
from placeloom.runtime import Scratch

#: Texts of a bucket of the tape, about.
BUCKET_TEXTS = 50_000


class Flow:
    """Min-cost flow by cheapest augmenting paths; capacities and costs are whole numbers."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist, via, queue, waiting = {s: 0}, {}, deque([s]), {s}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and dist[a] + self.cost[e] < dist.get(b, 1 << 60):
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if t not in dist:
                return total
            path, at = [], t
            while at != s:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push


def plan_mix(sums: dict[tuple[str, ...], int], weights: dict[str, float], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each set of sources that each source takes, at the largest total with all shares on target.

    A source that has no tokens at all takes no part; the weights of the others are scaled up.
    """
    sums = {p: n for p, n in sums.items() if n > 0}
    sources = sorted(s for s, w in weights.items() if w > 0 and repeats[s] > 0 and any(s in p for p in sums))
    patterns = sorted(sums)
    whole = sum((Fraction(weights[s]) for s in sources), Fraction(0))
    if not sources:
        return {}

    def solve(total: int) -> tuple[bool, dict]:
        flow, start, end = Flow(), 0, 1
        node = {p: 2 + i for i, p in enumerate(patterns)}
        sink = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
        arcs = {}
        for p in patterns:
            for use in range(max((repeats[s] for s in p if s in sink), default=0)):
                flow.arc(start, node[p], sums[p], use * use)
            for s in p:
                if s in sink:
                    arcs[p, s] = flow.arc(node[p], sink[s], sums[p] * repeats[s])
        quota = {s: int(total * Fraction(weights[s]) / whole) for s in sources}
        for s in sources:
            flow.arc(sink[s], end, quota[s])
        return flow.run(start, end) == sum(quota.values()), {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1]}

    low, high = 0, sum(n * max((repeats[s] for s in p if s in sources), default=0) for p, n in sums.items())
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if solve(mid)[0] else (low, mid - 1)
    return solve(low)[1]


def mix_sources(
    documents: DataFrame, targets: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``(doc_id, source, uses, n_tokens)``: the documents of the mixture and how often each is used.

    ``targets(source, weight, max_repeats)``, a short table read whole; of repeated rows of a source one counts.
    Texts that are equal in several sources are one document, which may serve any of them, and is named by its id
    there; copies within a source are documents of their own. Null, empty and blank-source documents, sources not
    listed, and those of weight or repeats 0 or null have no share. A document is never used more than ``max_repeats`` times for a source. The total is the
    largest at which every source that has any tokens can reach its weight; shares are then met to within a
    text or so. The choice depends on ``seed`` and the texts alone.

    To the driver come sums for each set of sources in which texts occur, not documents.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = targets.select(F.col(source_col).alias("source"), "weight", "max_repeats").filter("source is not null and weight > 0 and max_repeats > 0")
    wanted = {r.source: (r.weight, r.max_repeats) for r in rows.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).collect()}
    base = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    base = base.filter(F.col("id").isNotNull() & F.col("source").isin(list(wanted)) & (F.length("text") > 0)).withColumn("content", F.md5("text"))
    counted = scratch.write(token_counts(base, "text", vocabulary, ["id", "source", "content"]))
    # the first copy of a text in one source shares an item with the first in another, and so on
    each = counted.groupBy("content", "source", "id").agg(F.max("n_tokens").alias("n"))
    each = each.withColumn("copy", F.row_number().over(Window.partitionBy("content", "source").orderBy("id")))
    texts = each.groupBy("content", "copy").agg(F.array_sort(F.collect_list(F.struct("source", "id"))).alias("at"), F.max("n").alias("n")).withColumn("pattern", F.array_join("at.source", "\x1f"))
    texts = scratch.write(texts)
    sums = {tuple(r.pattern.split("\x1f")): (r.tokens, r.texts) for r in texts.groupBy("pattern").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("texts")).collect()}
    plan = plan_mix({p: t for p, (t, _) in sums.items()}, {s: w for s, (w, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()})
    stretches, begun = [], defaultdict(int)
    for (pattern, source), tokens in sorted(plan.items()):
        stretches.append(("\x1f".join(pattern), source, begun[pattern], tokens, sums[pattern][0]))
        begun[pattern] += tokens
    stretches = spark.createDataFrame(stretches, "pattern string, for string, a long, x long, whole long")
    buckets = max((n for _, n in sums.values()), default=0) // BUCKET_TEXTS + 1
    order = F.xxhash64("content", F.lit(seed))
    laid = texts.withColumn("o", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("o", 3), F.lit(buckets)))
    ahead = laid.groupBy("pattern", "bucket").agg(F.sum("n").alias("s"))
    before = ahead.withColumn("before", F.sum("s").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("s")).drop("s")
    inside = Window.partitionBy("pattern", "bucket").orderBy("o", "content", "copy")
    tape = laid.withColumn("c", F.sum("n").over(inside) - F.col("n")).join(before, ["pattern", "bucket"]).withColumn("c", F.col("c") + F.col("before"))
    met = tape.join(F.broadcast(stretches), "pattern")
    # starts of a text on the repeated tape, c, c + whole, ..., that fall into the stretch a .. a + x
    uses = F.ceil((F.col("a") + F.col("x") - F.col("c")) / F.col("whole")) - F.ceil((F.col("a") - F.col("c")) / F.col("whole"))
    picked = met.withColumn("uses", uses.cast("int")).filter("uses > 0 and n > 0")
    own = F.filter("at", lambda p: p["source"] == F.col("for"))[0]["id"]
    return picked.select(own.alias(id_col), F.col("for").alias("source"), "uses", F.col("n").alias("n_tokens"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, weight, documents, most_uses, tokens, share)``: what each listed source reached of all tokens."""
    sums = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    listed = targets.groupBy("source").agg(F.max("weight").alias("weight")).join(sums, "source", "left").fillna(0, ["documents", "most_uses", "tokens"])
    total = listed.agg(F.sum("tokens").alias("_all"))
    return listed.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")

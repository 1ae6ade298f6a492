"""Mixing sources to target weights by temperature, with capped repetition.

Weights lie on the path from the sources' own token shares (exponent 0) to the targets (exponent 1): each
source's own share is raised to one minus the exponent and multiplied by its target raised to the exponent.
The total is a budget, by default as many tokens as the corpus has, and the exponent is bisected to the
largest one at which no source must repeat a text more often than it may. The source that stops it there is
given all it may have, and for the others the exponent is bisected anew, until they meet their targets or all
are at their limits; the shares reached are reported beside the targets, with each source's exponent. ``most`` asks instead for the largest total at which the targets themselves are met;
it too is bisected, by the same test. With an entropy to meet, ``exponent_for_entropy`` finds the plain
temperature. The weights become budgets, and each budget is realised as whole passes over the source and a
part of one more pass in the order of a hash permutation: whole blocks of it, and an exact prefix in the one
block where the budget ends.

Defined results: sources are compared in lower case, without outer blanks, with ``_`` for ``-`` and blanks;
null and empty texts take no part; a text that occurs several times is one text (of its least id) and so
can't be used more often than it may; sources without target are left out, targets without text are reported
with nothing reached and the other targets keep their proportions; equal hashes go by id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from veinstone.session import cut

#: Blocks of a source's permutation, fewer if all sources together would have more than BLOCK_ROWS.
BLOCKS, BLOCK_ROWS = 4096, 200_000
#: Most sources with a target.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeats: int


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent, normalised."""
    raised = {k: v**exponent for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def exponent_for_entropy(shares: dict[str, float], wanted: float, steps: int = 60) -> float:
    """The exponent in 0..1 at which the tempered shares have the wanted entropy (the nearest end if none has)."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(tempered(shares, middle)) > wanted else (low, middle)
    return (low + high) / 2


def path_weights(sizes: dict[str, int], targets: dict[str, Target], exponent: float) -> dict[str, float]:
    """Weights between the sources' own shares (0) and the targets (1)."""
    total = sum(sizes.values())
    raised = {s: (n / total) ** (1 - exponent) * targets[s].weight**exponent for s, n in sizes.items() if n > 0 and targets[s].weight > 0}
    whole = sum(raised.values())
    return {s: v / whole for s, v in raised.items()}


def _bisect(holds, low: float, high: float, steps: int) -> float:
    """The greatest value found between low, at which holds is true, and high."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def budgets(sizes: dict[str, int], targets: dict[str, Target], total: int | None = None, steps: int = 60) -> tuple[dict[str, float], dict[str, float]]:
    """(tokens, exponent) of each source for a total; None for the largest total that meets the targets.

    A total beyond all allowed repetitions together gives every source at its limit.
    """
    left = {s: n for s, n in sizes.items() if s in targets and n > 0 and targets[s].weight > 0 and targets[s].max_repeats > 0}
    most = {s: n * targets[s].max_repeats for s, n in left.items()}
    fits = lambda weights, tokens: all(w * tokens <= most[s] * (1 + 1e-12) for s, w in weights.items())
    if total is None and left:
        wanted = path_weights(left, targets, 1.0)
        reach = _bisect(lambda t: fits(wanted, t), 0.0, float(sum(most.values())), steps + 40)
        return {s: w * reach for s, w in wanted.items()}, dict.fromkeys(left, 1.0)
    plan: dict[str, float] = {}
    exponents: dict[str, float] = {}
    rest = float(total or 0)
    while left:
        exponent = 1.0 if fits(path_weights(left, targets, 1.0), rest) else _bisect(lambda e: fits(path_weights(left, targets, e), rest), 0.0, 1.0, steps)
        weights = path_weights(left, targets, exponent)
        # those that stop the exponent: at their limit, or beyond it where even their own shares are too much
        nearest = max(weights[s] * rest / most[s] for s in left)
        stopped = [s for s in left if exponent == 1.0 or weights[s] * rest >= most[s] * (1 - 1e-9) or weights[s] * rest / most[s] == nearest]
        for s in stopped:
            plan[s], exponents[s] = min(weights[s] * rest if exponent == 1.0 else most[s], most[s]), exponent
        rest = max(0.0, rest - sum(plan[s] for s in stopped)) if exponent < 1.0 else 0.0
        left = {s: n for s, n in left.items() if s not in plan}
    return plan, exponents


def source_name(c: Column | str) -> Column:
    """The one spelling of a source."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[\s-]+", "_")


@dataclass(frozen=True)
class Mixture:
    """uses: item_id, source, n_tokens, n_uses. shares: source, target_weight, reached_share, tokens, most_uses, max_repeats, exponent (null without text). exponents: by source."""

    uses: DataFrame
    shares: DataFrame
    exponents: dict[str, float]


def mix(items: DataFrame, targets: DataFrame, total: int | str = "corpus", seed: int = 0, blocks: int = BLOCKS) -> Mixture:
    """A mixture of items (item_id long, source string, text_key, n_tokens long) for targets (source, target_weight, max_repeats).

    total: tokens of the mixture, ``corpus`` for as many as all texts of sources with a target have (repeated texts
    count once), ``most`` for the most that meets the targets.
    """
    spark = items.sparkSession
    rows = targets.select(source_name("source").alias("source"), "target_weight", "max_repeats").filter("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    wanted = {r.source: Target(r.source, float(r.target_weight or 0), int(r.max_repeats or 0)) for r in sorted(rows, key=lambda r: (r.source, r.target_weight or 0, r.max_repeats or 0))}
    blocks = max(1, min(blocks, BLOCK_ROWS // max(1, len(wanted))))
    # one row per text, in the source of its least id; combined in the tasks first
    first = F.min(F.struct("item_id", "source", "n_tokens"))
    texts = cut(
        items.filter("n_tokens > 0").withColumn("source", source_name("source")).groupBy("text_key").agg(first.alias("f")).select("f.*")
        .filter(F.col("source").isin(*wanted) if wanted else F.lit(False))
        .withColumn("order", F.xxhash64(F.lit(seed), "item_id")).withColumn("block", F.pmod(F.shiftrightunsigned("order", 20), F.lit(blocks)))
    )
    per_block = texts.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect()  # at most BLOCK_ROWS rows
    sizes: dict[str, int] = {}
    by_source: dict[str, list[tuple[int, int]]] = {}
    for r in per_block:
        sizes[r.source] = sizes.get(r.source, 0) + r.n
        by_source.setdefault(r.source, []).append((r.block, r.n))
    plan, exponents = budgets(sizes, wanted, sum(sizes.values()) if total == "corpus" else None if total == "most" else total)
    cuts = []  # source, whole passes, blocks before the last one, its number, tokens left for it
    for source, budget in plan.items():
        passes = min(int(budget // sizes[source]), wanted[source].max_repeats)
        rest = budget - passes * sizes[source] if passes < wanted[source].max_repeats else 0.0
        end, left = -1, 0.0
        for block, n in sorted(by_source[source]):
            end, left = block, rest
            if n > rest:
                break
            rest -= n
        else:
            end, left = blocks, 0.0
        cuts.append((source, passes, end, float(left)))
    schema = "source string, passes int, end_block int, left double"
    cut_rows = F.broadcast(spark.createDataFrame(cuts, schema))  # one row per target
    placed = texts.join(cut_rows, "source")
    whole = placed.filter(F.col("block") != F.col("end_block")).withColumn("more", (F.col("block") < F.col("end_block")).cast("int"))
    running = Window.partitionBy("source").orderBy("order", "item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter(F.col("block") == F.col("end_block")).withColumn("sum", F.sum("n_tokens").over(running))
    nearer = (F.col("sum") <= F.col("left")) | (F.col("sum") - F.col("left") < F.col("left") - (F.col("sum") - F.col("n_tokens")))
    edge = edge.withColumn("more", nearer.cast("int")).drop("sum")
    uses = whole.unionByName(edge).withColumn("n_uses", F.col("passes") + F.col("more")).filter("n_uses > 0").select("item_id", "source", "n_tokens", "n_uses")
    reached = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.max("n_uses").alias("most_uses"))
    all_targets = spark.createDataFrame([(t.source, t.weight, t.max_repeats, None if t.source not in exponents else round(exponents[t.source], 6)) for t in wanted.values()], "source string, target_weight double, max_repeats int, exponent double")
    report = all_targets.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    grand = Window.partitionBy()
    shares = report.select(
        "source", "target_weight", (F.col("tokens") / F.nullif(F.sum("tokens").over(grand), F.lit(0))).alias("reached_share"), "tokens", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats", "exponent"
    )
    return Mixture(uses, shares, exponents)

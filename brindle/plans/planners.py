"""Capacity planners: pure functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def disk_evictions(files: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """Files (path, bytes, mod_ms, owned, safe) to drop until the rest fits: oldest first, those not owned or owned and safe only.

    A file goes while the bytes that would be left without it and all before it still exceed the budget,
    so the running sum before it decides. A budget of 0 drops nothing. `by`: columns that name a node, each with the budget;
    without them the files are those of one node.
    """
    by = by or []
    if budget <= 0:
        return files.limit(0).select(*by, "path", "bytes")
    sizes = files.withColumn("total", F.sum("bytes").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy("mod_ms", "path").rowsBetween(Window.unboundedPreceding, -1)
    gone = sizes.where(~F.col("owned") | F.col("safe")).withColumn("before", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    return gone.where(F.col("total") - F.col("before") > budget).select(*by, "path", "bytes")


def rebalance(nodes: DataFrame, self_id: str, idle: DataFrame, most: int) -> DataFrame:
    """Idle cells (scope) that a node gives away, in order of scope. Nodes: node, cells, weight.

    As many as the node is above its share by weight, but no more than fit the peer that is farthest below
    98 % of its own share, nor more than `most`.
    """
    alive = nodes.where((F.col("weight") > 0) | (F.col("node") == self_id))
    shares = alive.join(F.broadcast(alive.agg(F.sum("cells").alias("all_cells"), F.sum("weight").alias("all_weight"))))
    share = F.col("all_cells") * F.col("weight") / F.col("all_weight")
    own, peer = F.col("node") == self_id, (F.col("node") != self_id)
    both = shares.agg(
        F.max(F.when(own & (F.col("weight") > 0), F.col("cells") - share)).alias("over"), F.max(F.when(peer, share * 0.98 - F.col("cells"))).alias("room")
    )
    move = both.select(F.greatest(F.least(F.floor("over"), F.floor("room"), F.lit(most)), F.lit(0)).alias("move"), (F.col("over").isNull() | F.col("room").isNull()).alias("none"))
    first = idle.select("scope").orderBy("scope").limit(max(0, most))
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("scope")))  # at most `most` rows
    return placed.join(F.broadcast(move)).where(~F.col("none") & (F.col("place") <= F.col("move"))).select("scope")


def autoscale(leases: DataFrame, now_ms: int, per_node: int, least: int, most: int = 0) -> DataFrame:
    """One row of advice from node leases (expiry, owned_cells, shed_cells, pressured): nodes, owned, desired, action.

    Leases without an expiry count. Pressure or shed cells ask for one node more than there are; `most` 0 is no limit.
    """
    live = leases.where((F.col("expiry") <= 0) | (F.col("expiry") >= now_ms)).agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.sum("owned_cells"), F.lit(0)).alias("owned"),
        F.coalesce(F.sum("shed_cells"), F.lit(0)).alias("shed"),
        F.count_if(F.col("pressured")).alias("pressured"),
    )
    need = F.ceil(F.col("owned") / F.lit(per_node))
    need = F.when((F.col("pressured") > 0) | (F.col("shed") > 0), F.greatest(need, F.col("nodes") + 1)).otherwise(need)
    need = F.greatest(need, F.lit(least))
    desired = (F.least(need, F.lit(most)) if most > 0 else need).cast("long")
    action = F.when((F.col("nodes") == 0) | (F.col("desired") > F.col("nodes")), "scale-up").when(F.col("desired") < F.col("nodes"), "scale-down").otherwise("hold")
    return live.withColumn("desired", desired).select("nodes", "owned", "desired", action.alias("action"))


def with_cooldown(advice: DataFrame, last_action: str, last_action_ms: int, now_ms: int, cooldown_ms: int) -> DataFrame:
    """Another action than the last one waits until the cooldown is over."""
    early = bool(last_action) and now_ms - last_action_ms < cooldown_ms
    return advice.withColumn("action", F.when(F.lit(early) & (F.col("action") != last_action), "hold").otherwise(F.col("action")))


def choose_hot(rates: dict[str, float], eligible: set[str], previous: list[str], most: int, swaps: int, factor: float) -> list[str]:
    """Next hot set of one worker.

    Free places go to the best newcomers. Beyond them a newcomer replaces the weakest member outside the
    best `most`, only with `factor` times its rate and `swaps` times at most. Members without traffic leave.
    If hardly a member changes and no newcomer is that much stronger than one that leaves, nothing changes.
    """
    if most <= 0:
        return []
    best = sorted(eligible, key=lambda h: (-rates[h], h))[:most]
    new = [h for h in best if h not in previous]
    weak = sorted((h for h in previous if h not in best), key=lambda h: (rates.get(h, 0.0), h))
    free = max(0, most - len(previous))
    members, waiting = set(previous) | set(new[:free]), new[free:]
    for comes, goes in list(zip(waiting, weak))[:swaps]:
        if rates[comes] < factor * rates.get(goes, 0.0):
            break
        members = members - {goes} | {comes}
    members = {h for h in members if h not in previous or rates.get(h, 0.0) > 0}
    chosen = sorted(members)[:most]
    added, removed = set(chosen) - set(previous), set(previous) - set(chosen)
    slack = max(1, most // 10)
    if len(chosen) == len(previous) and len(removed) <= slack and not any(rates[a] >= factor * rates.get(r, 0.0) > 0 for a in added for r in removed):
        return sorted(previous)
    return chosen


def hot_set(hosts: DataFrame, by: list[str], most: int, swaps: int, factor: float = 2.0, least_requests: int = 0) -> DataFrame:
    """Hot set of each group. Columns: host, requests, incumbent.

    Each swap depends on the one before, so a group is walked in one task: first cut, in parallel,
    to its members and the best `most` others, which are all that can matter.
    """
    import pandas as pd

    w = Window.partitionBy(*by, "incumbent").orderBy(F.desc("requests"), "host")
    few = hosts.withColumn("__n", F.row_number().over(w)).where(F.col("incumbent") | (F.col("__n") <= most)).drop("__n")
    kinds = dict(hosts.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"host {kinds['host']}"])

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rates = dict(zip(group.host, group.requests, strict=True))
        eligible = {h for h, n in rates.items() if n >= least_requests}
        out = pd.DataFrame({"host": choose_hot(rates, eligible, list(group.host[group.incumbent]), most, swaps, factor)})
        for c, v in zip(by, key, strict=True):
            out.insert(0, c, v)
        return out[[*by, "host"]]

    return few.groupBy(*by).applyInPandas(walk, schema)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Added and removed keys."""
    old, new = before.select(key).distinct(), after.select(key).distinct()
    added = new.join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, key, "left_anti").withColumn("change", F.lit("removed")))

"""Samples dealt out in turns, and who stands behind a range of commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(candidates: DataFrame, groups: list[str], cycle: list[str], n: int, seed: int = 1, max_rounds: int = 200) -> DataFrame:
    """(turn, id, grp, language, repo): ``n`` rows of ``candidates(id, grp, language, repo)``, each repository once.

    Groups take turns; a group's turn asks for the next language of the cycle, or any if none of it is left. A group's
    rows come in the order of a seeded hash, then id. As no more than ``n`` repositories are ever used, the first ``n``
    repositories of each group and language hold every row that can be taken: they are found by Spark, each task
    handing on its own first ones, and the turns run over those few. Rows with a null group, language or repository
    are left out.
    """
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id"))
    known = candidates.where(F.col("grp").isin(groups) & F.col("language").isNotNull() & F.col("repo").isNotNull() & F.col("id").isNotNull())
    firsts = known.groupBy("grp", "language", "repo").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("grp", "language").orderBy("o"))
    rows = firsts.withColumn("__n", place).where(F.col("__n") <= n).select("grp", "language", "repo", "o.h", "o.id").collect()  # groups x languages x n
    pools = {g: sorted((r for r in rows if r.grp == g), key=lambda r: (r.h, r.id)) for g in groups}
    used, taken = set(), []
    for _ in range(max_rounds):
        for i, g in enumerate(groups):
            if len(taken) >= n:
                break
            wanted = cycle[(len(taken) // len(groups) + i) % len(cycle)]
            free = [r for r in pools[g] if r.repo not in used]
            pick = next((r for r in free if r.language == wanted), free[0] if free else None)
            if pick is not None:
                used.add(pick.repo)
                taken.append((len(taken) + 1, pick.id, g, pick.language, pick.repo))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.sparkSession.createDataFrame(taken, f"turn int, id {kinds['id']}, grp string, language string, repo {kinds['repo']}")


def agents_in_range(commits: DataFrame, most_commits: int = 200) -> DataFrame:
    """(range, agents): the tools behind a range's first ``most_commits`` commits, each once, in the order of first sight.

    ``commits(range, position, agent)``, positions in history order and unique within a range; a null agent is a
    person. Each task cuts its own rows to the limit before they are shuffled. Ranges without an agent have an empty
    array.
    """
    place = F.row_number().over(Window.partitionBy("range").orderBy("position"))
    near = commits.withColumn("__n", place).where(F.col("__n") <= most_commits)
    seen = near.groupBy("range", "agent").agg(F.min("position").alias("first"))
    known = F.collect_list(F.when(F.col("agent").isNotNull(), F.struct("first", "agent")))
    return seen.groupBy("range").agg(F.transform(F.array_sort(known), lambda x: x["agent"]).alias("agents"))


def authorship(tier: Column, authored: Column, agent: Column, agents: Column) -> Column:
    """struct<authored_by_agent, agent>: blame if it knows, else for added and modified items whether, and which, an agent
    is in the range. Unknown agents of a range (null) leave both open."""
    open_ = F.coalesce(tier.isin("added", "modified"), F.lit(False)) & authored.isNull() & agents.isNotNull()
    return F.struct(
        F.when(open_, F.size(agents) > 0).otherwise(authored).alias("authored_by_agent"), F.when(open_, F.try_element_at(agents, F.lit(1))).otherwise(agent).alias("agent")
    )

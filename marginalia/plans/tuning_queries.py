"""Queries of threshold tuning: judged items are documents with labels, answers are arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import tuning as TU
from .queries import _P, V5, query, t

_G = {a: [str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" for v in values] for a, values in TU.GRID.items()}
_AXIS = ", ".join(f"(SELECT unnest([{', '.join(v)}]) AS t_{a}, unnest(range({len(v)})) AS i_{a})" for a, v in _G.items())


def _place() -> str:
    out = "0"
    for a, v in _G.items():
        out = f"({out}) * {len(v)} + i_{a}"
    return out


ITEMS = f"""a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'todo' WHEN doc_id % 2 = 0 THEN 'inline' ELSE 'api_doc' END AS kind,
  {V5}[1 + (doc_id * 7 + quality * 3 + toxic) % 5] AS gold, toxic = 1 AS hazard_label, coalesce((doc_id * 13 % 100) / 100.0 > 0.5, false) OR (doc_id * 29 % 100) / 100.0 > 0.5 AS error,
  length(text) - length(replace(text, chr(10), '')) + 1 > 1 AS long, doc_id % 11 = 0 AS unit,
  CASE WHEN doc_id % 17 <> 0 THEN {_P[17]} END AS g1, {_P[23]} AS hz, {_P[31]} AS leak, 3 * {_P[37]} AS c2, CASE WHEN doc_id % 13 <> 0 THEN 3 * {_P[43]} END AS c3,
  3 * {_P[47]} AS c5, 3 * {_P[53]} AS c8, {_P[41]} AS fully, 1 - {_P[41]} AS w, doc_id % 3 <> 0 AS asked, CASE WHEN doc_id % 7 <> 0 THEN {V5}[1 + (doc_id * 5 % 5 + doc_id // 7) % 5] END AS holistic
  FROM documents JOIN labels USING (doc_id)),
items AS (SELECT *, (2 * c2 / 3 + 3 * c5 / 3 + 2 * c8 / 3 + 0.5 * w) / 7.5 AS api FROM a),
grid AS (SELECT *, {_place()} AS place FROM {_AXIS}),
decided AS (SELECT place, gold, hazard_label, error, long, unit, asked, holistic, t_margin AS m, t_use_holistic AS uh, {", ".join(f"t_{a}" for a in TU.AXES)}, g1, c2, fully, hz, c3, leak, c5, api, CASE
  WHEN kind = 'todo' THEN 'keep' WHEN g1 IS NULL THEN 'review' WHEN g1 > t_g1 THEN 'wrong'
  WHEN kind = 'api_doc' THEN CASE WHEN api < t_api_delete THEN 'api1' WHEN c5 < 0.5 THEN 'api2' WHEN api < t_api_rewrite THEN 'api3' ELSE 'api4' END
  WHEN c2 < t_c2_min THEN 'c2' WHEN fully > t_rename THEN 'ren' WHEN hz < t_hazard THEN CASE WHEN c3 IS NULL THEN 'review' WHEN c3 < t_c3_min THEN 'c3a' ELSE 'c3b' END
  WHEN leak > 0.6 THEN 'leaka' ELSE 'leakb' END AS leaf FROM items, grid),
verdicts AS (SELECT *, CASE WHEN leaf IN ('keep', 'review') THEN leaf
  WHEN abs(g1 - t_g1) < m OR (leaf LIKE 'api%' AND abs(api - t_api_delete) < m) OR (leaf IN ('api2', 'api3', 'api4') AND abs(c5 - 0.5::DOUBLE) < m * 3) OR (leaf IN ('api3', 'api4') AND abs(api - t_api_rewrite) < m)
    OR (leaf IN ('c2', 'ren', 'c3a', 'c3b', 'leaka', 'leakb') AND abs(c2 - t_c2_min) < m * 3) OR (leaf IN ('ren', 'c3a', 'c3b', 'leaka', 'leakb') AND abs(fully - t_rename) < m)
    OR (leaf IN ('c3a', 'c3b', 'leaka', 'leakb') AND abs(hz - t_hazard) < m) OR (leaf IN ('c3a', 'c3b') AND abs(c3 - t_c3_min) < m * 3) OR (leaf IN ('leaka', 'leakb') AND abs(leak - 0.6::DOUBLE) < m) THEN 'review'
  WHEN leaf = 'wrong' THEN 'fix_wrong_claim' WHEN leaf IN ('api1', 'api2', 'c2', 'c3a') THEN 'delete' WHEN leaf = 'ren' THEN 'rename_instead' WHEN leaf IN ('api3', 'leaka') THEN 'rewrite_shorter'
  WHEN leaf = 'api4' THEN 'keep' WHEN long THEN 'rewrite_shorter' ELSE 'keep' END AS v0 FROM decided),
guarded AS (SELECT *, CASE WHEN uh AND asked AND leaf <> 'keep' AND v0 <> 'review' AND holistic IS DISTINCT FROM v0 THEN 'review'
  WHEN unit AND v0 IN ('delete', 'rename_instead') THEN CASE WHEN long THEN 'rewrite_shorter' ELSE 'keep' END ELSE v0 END AS v FROM verdicts),
costs AS (SELECT place, sum(CASE WHEN v = 'review' THEN 5 ELSE
  CASE WHEN v IN ('delete', 'rename_instead') THEN CASE WHEN hazard_label AND gold IN ('keep', 'rewrite_shorter') THEN 100 WHEN gold NOT IN ('delete', 'rename_instead') THEN 10 ELSE 0 END ELSE 0 END
  + CASE WHEN v IN ('rewrite_shorter', 'fix_wrong_claim') THEN CASE WHEN gold = 'keep' THEN 10 ELSE 0 END + CASE WHEN error THEN 30 ELSE 0 END ELSE 0 END
  + CASE WHEN v = 'keep' AND gold <> 'keep' THEN 3 ELSE 0 END END)::BIGINT AS cost FROM guarded GROUP BY place),
priced AS (SELECT place, {", ".join(f"t_{a} AS {a}" for a in TU.GRID)}, cost FROM grid JOIN costs USING (place))"""


def tuning_items(spark, sf):
    d = F.col("doc_id")
    p = lambda m: (d * m % 100) / 100.0
    yes = lambda m: F.create_map(F.lit("true"), p(m), F.lit("false"), 1 - p(m))
    score = lambda m: F.create_map(F.lit("0"), 1 - p(m), F.lit("3"), p(m))
    rep = F.create_map(F.lit("no"), 1 - p(41), F.lit("fully"), p(41))
    names = F.array(*[F.lit(v) for v in (*P.VERDICTS, "review")])
    pick = F.get(names, ((d * 5 % 5 + F.floor(d / 7)) % 5).cast("int"))
    other = F.get(names, ((d * 5 % 5 + F.floor(d / 7) + 1) % 5).cast("int"))
    verdict = F.when(d % 7 != 0, F.create_map(pick, F.lit(0.7), other, F.lit(0.3))).otherwise(F.create_map(pick, F.lit(0.5), other, F.lit(0.5)))
    every = [
        F.when(d % 17 != 0, F.struct(F.lit("g1_contradicts").alias("k"), yes(17).alias("v"))), F.when(d % 13 != 0, F.struct(F.lit("c3_rationale").alias("k"), score(43).alias("v"))),
        F.when(d % 3 != 0, F.struct(F.lit("verdict").alias("k"), verdict.alias("v"))), F.struct(F.lit("c9_replaceable").alias("k"), rep.alias("v")),
        *[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in {"hazard": yes(23), "leak": yes(31), "c2_info_gain": score(37), "c5_contract": score(47), "c8_durability": score(53)}.items()],
    ]
    rows = t(spark, sf, "documents").select("doc_id", "text").join(t(spark, sf, "labels"), "doc_id")
    return rows.select(
        F.when(d % 10 == 0, "todo").when(d % 2 == 0, "inline").otherwise("api_doc").alias("kind"), F.col("text").alias("comment"),
        F.map_from_entries(F.array_compact(F.array(*every))).alias("answers"), F.when(d % 11 == 0, "unit").alias("unit"),
        F.get(names, ((d * 7 + F.col("quality") * 3 + F.col("toxic")) % 5).cast("int")).alias("gold"), (F.col("toxic") == 1).alias("hazard_label"),
        ((d * 13 % 100) / 100.0).alias("adds"), ((d * 29 % 100) / 100.0).alias("g1_candidate"),
    )


@query(f"WITH {ITEMS} SELECT * FROM priced")
def tuning_costs(spark, sf):
    """The cost of all 29,160 grid points."""
    return TU.grid_costs(tuning_items(spark, sf))


@query(f"WITH {ITEMS} SELECT CASE WHEN cost = (SELECT cost FROM priced WHERE {' AND '.join(f'{a} = {_G[a][0]}' for a in TU.AXES)} AND margin = 0 AND NOT use_holistic) THEN -1 ELSE place END AS place, * EXCLUDE (place) FROM priced ORDER BY cost, place LIMIT 1")
def tuning_best(spark, sf):
    """The cheapest point; the shipped thresholds win ties."""
    return TU.tune(tuning_items(spark, sf))

"""Cost of every point of a threshold grid from one pass over the judged items.

A verdict of the policy is a leaf of a decision tree, reached under conditions like "value over threshold". On a
grid axis in ascending order the thresholds that meet a condition are its first or its last ones, so a leaf covers a
box of grid points with one open corner: the item is counted once in the cell of that corner. Cumulating the cells
along every axis (a summed-area table) gives each leaf's cost at every point, and a grid point adds up its leaves.
The tables have as many cells as the grid, whatever the number of items; items are never paired with grid points.

Costs are whole tenths, so sums don't depend on their order and ties are ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..session import saved
from .metrics import REMOVE, REWRITE

# The grid that is searched, in the order in which equal costs are settled.
GRID = {
    "g1": (0.4, 0.5, 0.6, 0.7, 0.8), "c2_min": (0.5, 0.75, 1.0, 1.25), "rename": (0.5, 0.7, 0.9), "hazard": (0.3, 0.5, 0.7), "c3_min": (1.0, 1.5, 2.0),
    "api_delete": (0.2, 0.3, 0.4), "api_rewrite": (0.45, 0.55, 0.65), "margin": (0.0, 0.05, 0.15), "use_holistic": (True, False),
}
#: Axes of the cells; the margin has cells of its own, and whether the holistic answer counts is two values of a cell.
AXES = ("g1", "c2_min", "rename", "hazard", "c3_min", "api_delete", "api_rewrite")
REVIEW = 5  # tenths


def cumulate(cells: DataFrame, keys: Sequence[str], axes: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Running sums of ``values`` along each axis in turn, within ``keys``; every cell must be there."""
    for axis in axes:
        window = Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumns({v: F.sum(v).over(window) for v in values})
    return cells


def dense(spark: SparkSession, shapes: dict[str, Sequence[int]], names: Sequence[str]) -> DataFrame:
    """(leaf, names): every cell of each leaf's shape."""
    rows = [(leaf, *at) for leaf, shape in shapes.items() for at in product(*map(range, shape))]
    return spark.createDataFrame(rows, "leaf string, " + ", ".join(f"{n} int" for n in names))


@dataclass(frozen=True)
class Condition:
    """``value`` (SQL) over or under the axis's threshold, or not; ``axis`` may be a fixed threshold of no axis."""

    axis: str
    value: str
    over: bool
    met: bool
    scale: int = 1

    def holds(self, threshold: float, margin: float | None = None) -> str:
        hit = f"{self.value} {'>' if self.over else '<'} {threshold}D"
        hit = hit if self.met else f"NOT ({hit})"
        return f"({hit})" if margin is None else f"({hit} AND NOT (abs({self.value} - {threshold}D) < {margin}D * {self.scale}))"

    @property
    def first(self) -> bool:
        """Whether the first thresholds of the axis meet the condition (else the last ones)."""
        return self.over == self.met

    def corner(self, grid: Sequence[float], margin: float | None = None) -> str:
        """Thresholds that don't meet the condition: the place of the box's corner, counted from its far side."""
        return f"({len(grid)} - " + " - ".join(f"int({self.holds(t, margin)})" for t in grid) + ")"


@dataclass(frozen=True)
class Leaf:
    name: str
    verdict: str
    conditions: tuple[Condition, ...]
    reached: str = "true"  # what no axis decides
    checked: tuple[Condition, ...] = ()  # comparisons with fixed thresholds that the margin holds for


def values_of(items: DataFrame, cap_lines: int) -> DataFrame:
    """What the policy compares, as columns, from ``items(kind, comment, answers, unit, gold, hazard_label, adds, g1_candidate)``."""
    a = lambda name: F.try_element_at("answers", F.lit(name))
    score = lambda name: P.expectation(a(name))
    lines = F.length("comment") - F.length(F.replace("comment", F.lit("\n"), F.lit(""))) + 1
    holistic = a("verdict")
    top = F.array_max(F.map_values(holistic))
    best = F.transform(F.filter(F.map_entries(holistic), lambda e: e["value"] == top), lambda e: e["key"])
    bad = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0.5
    out = items.select(
        F.coalesce("kind", F.lit("inline")).alias("kind"), "gold", F.coalesce("hazard_label", F.lit(False)).alias("hazard_label"),
        (bad("adds") | bad("g1_candidate")).alias("error"), (F.coalesce(lines, F.lit(1)) > cap_lines).alias("long"), F.col("unit").isNotNull().alias("unit"),
        (F.size(F.coalesce(holistic, F.create_map().cast("map<string,double>"))) > 0).alias("asked"), F.when(F.size(best) == 1, best[0]).alias("holistic"),
        P.prob(F.col("answers"), "g1_contradicts", "true").alias("g1"), P.prob(F.col("answers"), "hazard", "true").alias("hazard"),
        P.prob(F.col("answers"), "leak", "true").alias("leak"), P.prob(F.col("answers"), "c9_replaceable", "fully").alias("fully"),
        score("c2_info_gain").alias("c2"), score("c3_rationale").alias("c3"), score("c5_contract").alias("c5"), score("c8_durability").alias("c8"),
        P.replaceable_weight(a("c9_replaceable")).alias("w"),
    )
    return out.withColumn("api", F.expr("(2 * c2 / 3 + 3 * c5 / 3 + 2 * c8 / 3 + 0.5 * w) / 7.5"))


def tree(th: dict) -> list[Leaf]:
    """The policy's leaves; missing answers lead to a review of their own."""
    api, inline = "kind = 'api_doc'", "kind <> 'api_doc'"
    g1 = lambda met: Condition("g1", "g1", True, met)
    c2 = lambda met: Condition("c2_min", "c2", False, met, 3)
    ren = lambda met: Condition("rename", "fully", True, met)
    haz = lambda met: Condition("hazard", "hazard", False, met)
    c3 = lambda met: Condition("c3_min", "c3", False, met, 3)
    cut = lambda met: Condition("api_delete", "api", False, met)
    short = lambda met: Condition("api_rewrite", "api", False, met)
    c5 = lambda met: Condition("c5_min", "c5", False, met, 3)
    leak = lambda met: Condition("leak", "leak", True, met)
    review, shown = "'review'", "if(long, 'rewrite_shorter', 'keep')"
    low, high = (g1(False), c2(False), ren(False), haz(True)), (g1(False), c2(False), ren(False), haz(False))
    plain = lambda kind, x: f"{kind} AND {x.holds(th[x.axis])}"
    return [
        Leaf("g1?", review, (), "g1 IS NULL"),
        Leaf("wrong", "'fix_wrong_claim'", (g1(True),)),
        Leaf("api?", review, (g1(False),), f"{api} AND api IS NULL"),
        Leaf("api_cut", "'delete'", (g1(False), cut(True)), api),
        Leaf("api_c5", "'delete'", (g1(False), cut(False)), plain(api, c5(True)), (c5(True),)),
        Leaf("api_short", "'rewrite_shorter'", (g1(False), cut(False), short(True)), plain(api, c5(False)), (c5(False),)),
        Leaf("api_keep", "'keep'", (g1(False), cut(False), short(False)), plain(api, c5(False)), (c5(False),)),
        Leaf("c2?", review, (g1(False),), f"{inline} AND c2 IS NULL"),
        Leaf("c2", "'delete'", (g1(False), c2(True)), inline),
        Leaf("rename?", review, (g1(False), c2(False)), f"{inline} AND fully IS NULL"),
        Leaf("rename", "'rename_instead'", (g1(False), c2(False), ren(True)), inline),
        Leaf("hazard?", review, (g1(False), c2(False), ren(False)), f"{inline} AND hazard IS NULL"),
        Leaf("c3?", review, low, f"{inline} AND c3 IS NULL"),
        Leaf("c3", "'delete'", (*low, c3(True)), inline),
        Leaf("mild", shown, (*low, c3(False)), inline),
        Leaf("leak?", review, high, f"{inline} AND leak IS NULL"),
        Leaf("leak", "'rewrite_shorter'", high, plain(inline, leak(True)), (leak(True),)),
        Leaf("safe", shown, high, plain(inline, leak(False)), (leak(False),)),
    ]


_REMOVE, _REWRITE = (", ".join(f"'{v}'" for v in x) for x in (REMOVE, REWRITE))


def tenths(v: str) -> str:
    """SQL of what the verdict ``v`` costs against ``gold``, in tenths."""
    lost = f"hazard_label AND gold IN ('keep', 'rewrite_shorter') AND {v} IN ({_REMOVE})"
    return f"""if({v} = 'review', {REVIEW}, CASE WHEN {lost} THEN 100 WHEN {v} IN ({_REMOVE}) AND gold NOT IN ({_REMOVE}) THEN 10 ELSE 0 END
      + if({v} IN ({_REWRITE}) AND gold = 'keep', 10, 0) + if({v} = 'keep' AND gold <> 'keep', 3, 0) + if({v} IN ({_REWRITE}) AND error, 30, 0))"""


def _costs(v: str) -> tuple[str, str]:
    """With the holistic answer and without it, a unit literal guarded in both."""
    guarded = f"if(unit AND {v} IN ({_REMOVE}), if(long, 'rewrite_shorter', 'keep'), {v})"
    differs = f"asked AND {v} <> 'review' AND NOT coalesce(holistic = {v}, false)"
    return f"if({differs}, {REVIEW}, {tenths(guarded)})", tenths(guarded)


def _cell(leaf: str, m: int, reached: list[str], places: dict[str, str], yes: str, no: str) -> str:
    at = ", ".join(f"'p_{a}', {places.get(a, '0')}" for a in AXES)
    made = f"named_struct('leaf', '{leaf}', 'm', {m}, {at}, 'yes', bigint({yes}), 'no', bigint({no}))"
    return f"CASE WHEN {' AND '.join(f'({r})' for r in reached)} THEN {made} END"


def _contributions(leaf: Leaf, th: dict, grid: dict) -> list[str]:
    with_holistic, without = _costs(leaf.verdict)
    known = [f"{x.value} IS NOT NULL" for x in leaf.conditions + leaf.checked]

    def cell(m: int, margin: float | None, yes: str, no: str) -> str:
        at = {x.axis: x.corner(grid[x.axis], margin) for x in leaf.conditions}
        far = [x.holds(th[x.axis], margin) for x in leaf.checked] if margin is not None else []
        inside = [f"{at[x.axis]} < {len(grid[x.axis])}" for x in leaf.conditions]
        return _cell(leaf.name, m, ["kind NOT IN ('todo', 'directive')", leaf.reached, *known, *inside, *far], at, yes, no)

    out = []
    for m, margin in enumerate(grid["margin"]):
        if margin == 0 or leaf.name.endswith("?"):
            out.append(cell(m, None, with_holistic, without))
        else:  # near a threshold it is a review, elsewhere what the leaf costs
            out += [cell(m, None, str(REVIEW), str(REVIEW)), cell(m, margin, f"{with_holistic} - {REVIEW}", f"{without} - {REVIEW}")]
    return out


def grid_costs(items: DataFrame, th: dict | None = None, grid: dict | None = None) -> DataFrame:
    """(place, the nine thresholds, cost): the total cost in tenths of every grid point, ``place`` in the grid's order.

    ``items(kind, comment, answers, unit, gold, hazard_label, adds, g1_candidate)``. Thresholds of no axis are those
    of ``th``. Items of kind todo or directive are kept at every point. No items: every point costs 0. Axis values
    must ascend.
    """
    th, grid = P.load_thresholds(th), grid or GRID
    for axis in (*AXES, "margin"):
        if list(grid[axis]) != sorted(set(grid[axis])):
            raise ValueError(f"values of {axis} must ascend")
    spark = items.sparkSession
    leaves = tree(th)
    rows = values_of(items, th["cap_lines"])
    made = [x for leaf in leaves for x in _contributions(leaf, th, grid)]
    made += [_cell("kept", m, ["kind IN ('todo', 'directive')"], {}, tenths("'keep'"), tenths("'keep'")) for m in range(len(grid["margin"]))]
    places = [f"p_{a}" for a in AXES]
    each = rows.select(F.expr(f"explode(array_compact(array({', '.join(made)})))").alias("x")).select("x.*")
    # Written, so that the large expression is planned once; at most as many rows as the grid has cells.
    cells = saved(each.groupBy("leaf", "m", *places).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "tuning-cells")

    used = {leaf.name: {x.axis: x.first for x in leaf.conditions} for leaf in leaves} | {"kept": {}}
    shapes = {name: [len(grid["margin"]), *[len(grid[a]) if a in axes else 1 for a in AXES]] for name, axes in used.items()}
    full = dense(spark, shapes, ["m", *places]).join(cells, ["leaf", "m", *places], "left").na.fill(0, ["yes", "no"])
    sums = cumulate(full, ["leaf", "m"], places, ["yes", "no"])

    sizes = {a: len(v) for a, v in grid.items()}
    point, step = {}, 1
    for a in reversed(list(grid)):  # the last axis runs fastest
        point[a] = ((F.col("place") / step).cast("long") % sizes[a]).cast("int")
        step *= sizes[a]
    points = spark.range(step).withColumnRenamed("id", "place").withColumns({f"i_{a}": c for a, c in point.items()})
    asks = F.array(
        *[
            F.struct(
                F.lit(name).alias("leaf"),
                *[(F.lit(0) if a not in axes else F.lit(sizes[a] - 1) - F.col(f"i_{a}") if axes[a] else F.col(f"i_{a}")).cast("int").alias(f"p_{a}") for a in AXES],
            )
            for name, axes in used.items()
        ]
    )
    asked = points.withColumn("x", F.explode(asks)).select("place", *[f"i_{a}" for a in grid], F.col("i_margin").alias("m"), "x.*")
    met = asked.join(F.broadcast(sums), ["leaf", "m", *places])  # as many rows as the grid has cells
    cost = F.sum(F.when(F.get(F.array(*map(F.lit, grid["use_holistic"])), "i_use_holistic"), F.col("yes")).otherwise(F.col("no")))
    total = met.groupBy("place", *[f"i_{a}" for a in grid]).agg(cost.alias("cost"))
    value = lambda a: F.get(F.array(*[F.lit(v) for v in grid[a]]), f"i_{a}").alias(a)
    return total.select("place", *[value(a) for a in grid], "cost")


def cost_at(items: DataFrame, th: dict | None = None) -> DataFrame:
    """(cost): the total cost in tenths at one set of thresholds, by the policy itself."""
    made = P.decide(F.coalesce("kind", F.lit("inline")), F.coalesce("comment", F.lit("")), F.col("answers"), F.col("unit"), th)
    bad = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0.5
    rows = items.select("gold", F.coalesce("hazard_label", F.lit(False)).alias("hazard_label"), (bad("adds") | bad("g1_candidate")).alias("error"), made["verdict"].alias("v"))
    return rows.agg(F.coalesce(F.sum(F.expr(tenths("v"))), F.lit(0)).cast("long").alias("cost"))


def tune(items: DataFrame, th: dict | None = None, grid: dict | None = None) -> DataFrame:
    """The cheapest thresholds and their cost in tenths; the given ones, then the earliest grid point, win ties."""
    th, grid = P.load_thresholds(th), grid or GRID
    names = list(grid)
    start = cost_at(items, th).select(F.lit(-1).cast("long").alias("place"), *[F.lit(th[a]).alias(a) for a in names], "cost")
    every = start.unionByName(grid_costs(items, th, grid))
    best = every.agg(F.min_by(F.struct("place", *names, "cost"), F.struct("cost", "place")).alias("x"))
    return best.select("x.*")

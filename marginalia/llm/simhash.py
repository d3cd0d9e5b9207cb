"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at ``radius`` or fewer differing bits have a common variant within half the radius of
each. Every distinct fingerprint therefore emits its whole ball of half the radius (65 variants for radius
2), the variants are shuffled, and the fingerprints that meet on a variant are chained and verified. As all
that meet on a variant lie within the radius of each other, the chain keeps every component without
emitting all pairs of a group, and a group has no more members than a ball has points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved, space_words
from .components import connected_components

_CHUNK = 65536


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """64-bit SimHash of word shingles as a signed integer; no words: 0.

    A bit is 1 if over half of the shingle hashes (XXH64, seed 42, repeats included) have it.
    """
    words = space_words(text)
    if not words:
        return 0
    flat = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_digest
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(n, at + _CHUNK)], ends[at + k - 1 : at + k - 1 + _CHUNK])
        hashes = b"".join([digest(flat[a:b], 42) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id_col, fp) of every row, whole texts; other columns are ignored. Null or wordless text: fp 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` of 64 bits, as signed integers."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Edges (a, b) that connect all ``nodes(fp, node)``, fp distinct, within ``radius`` differing bits.

    Nodes meet only where they agree in the columns ``by``. Without a column ``node``, edges join fingerprints.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: balls of half the radius meet in the middle")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    node = "node" if "node" in nodes.columns else "fp"
    held = [*by, *dict.fromkeys(["fp", node])]
    variants = nodes.select(*held, F.explode(masks).alias("mask")).select(
        *held, F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = Window.partitionBy(*by, "variant").orderBy("fp")
    pairs = variants.select(F.col(node).alias("a"), "fp", F.lag(node).over(met).alias("b"), F.lag("fp").over(met).alias("ofp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("ofp"))) <= radius
    return pairs.where(F.col("b").isNotNull() & near).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2
) -> DataFrame:
    """(id_col, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Rows with equal fingerprints collapse to one node before anything is shuffled by fingerprint, so copies
    never expand to pairs. Fingerprints themselves are linked, so rows with a null id connect others, but name
    no component: one without any other id has a null component_id. Repeated ids are kept; an empty table gives
    no rows.
    """
    fps = saved(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = connected_components(links(nodes.select("fp"), radius))
    # Components are named by a fingerprint first, and by their smallest id once they are whole.
    linked = saved(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "linked")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(linked.join(ids, "component").select("fp", "component_id"), "named")
    forget(nodes, linked)
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


@dataclass(frozen=True)
class CopyParams:
    shingle_words: int = 5
    #: Least share of common shingles (Jaccard) of a near copy.
    similarity: float = 0.8
    #: Fingerprints of a text, each with weights of its own, and differing bits at which they meet.
    tables: int = 4
    radius: int = 2
    #: Shingles get the pseudo-random weight u ** -tail, u uniform in (0, 1].
    tail: float = 3.0


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct XXH64 values (seed 42) of k-word shingles; fewer words: of the whole; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    k, hashed = min(k, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)], np.uint64))


def _mixed(h: np.ndarray, seed) -> np.ndarray:
    """The finaliser of splitmix64 over hashes and a seed, or a column of seeds."""
    z = h + seed * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def weighted_fingerprints(shingles: np.ndarray, tables: int, tail: float) -> list[int]:
    """64-bit SimHashes of a shingle set with heavy-tailed pseudo-random weights, signed; no shingles: 0.

    Plain SimHash has about 10 of 64 bits differ between texts that share 0.8 of their shingles, more than a
    ball can bridge. Where a few shingles carry most of the weight, texts that have them in common differ in
    hardly any bit, and texts that don't differ in half.
    """
    if not len(shingles):
        return [0] * tables
    seeds = np.arange(tables, dtype=np.uint64)[:, None] * np.uint64(2)
    drawn, n, step = _mixed(shingles, seeds + np.uint64(1)), len(shingles), 32
    if n > step:
        drawn = np.partition(drawn, step, axis=1)
    votes = _votes(drawn[:, :step], seeds, tail)
    for t in range(tables if n > step else 0):
        # The heaviest shingles have voted. The others do only if they could still turn a bit.
        if np.abs(votes[t]).min() <= 1.001 * _weights(drawn[t, step : step + 1], tail)[0] * (n - step):
            votes[t] += _votes(drawn[t : t + 1, step:], seeds[t], tail)[0]
    packed = np.packbits(votes > 0, axis=1)
    return [int.from_bytes(row.tobytes(), "big", signed=True) for row in packed]


def _votes(drawn: np.ndarray, seeds: np.ndarray, tail: float) -> np.ndarray:
    """Sums of the weights, by table and bit, positive where the bit is set and negative where it isn't."""
    weights = _weights(drawn, tail)[:, None, :]
    bits = np.unpackbits(_mixed(drawn, seeds + np.uint64(2)).view(np.uint8)).reshape(*drawn.shape, 64)
    return (2.0 * (weights @ bits.astype(np.float64)) - weights.sum(axis=2, keepdims=True))[:, 0]


def _weights(drawn: np.ndarray, tail: float) -> np.ndarray:
    return (((drawn >> np.uint64(11)).astype(np.float64) + 1) / 2**53) ** -tail


def copy_fingerprints(docs: DataFrame, id_col: str, text_col: str, p: CopyParams) -> DataFrame:
    """(id, text_key, n, f0, f1, ...) of every row: a digest of the words, distinct shingles, fingerprints."""
    names = [f"f{t}" for t in range(p.tables)]

    def run(batches):
        for batch in batches:
            keys, sizes, fps = [], [], [[] for _ in names]
            for text in batch.column(1).to_pylist():
                words = space_words(text)
                shingles = shingle_set(words, p.shingle_words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(shingles))
                for column, fp in zip(fps, weighted_fingerprints(shingles, p.tables, p.tail)):
                    column.append(fp)
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(c, pa.int64()) for c in fps]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "n", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key binary, n long, " + ", ".join(f"{c} long" for c in names))


def _meetings(texts: DataFrame, p: CopyParams) -> tuple[DataFrame, DataFrame]:
    """(t, fp, node) of the fingerprints that several texts have, and (node) of all texts that meet another."""
    names = [f"f{t}" for t in range(p.tables)]
    keys = [F.col(c) for c in names] + [F.xxhash64(*pair) for pair in combinations(names, 2)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), key.alias("fp")) for t, key in enumerate(keys)])
    held = texts.select("node", F.explode(keys).alias("k")).select("node", "k.t", "k.fp")
    nodes = saved(held.groupBy("t", "fp").agg(F.min("node").alias("node"), F.count("*").alias("held")), "copy-nodes")
    groups = saved(held.join(nodes.where("held > 1").select("t", "fp"), ["t", "fp"]), "copy-groups")
    # The widest shuffle of all: it carries fingerprints alone, their texts are looked up after.
    alone = nodes.where(F.col("t") < p.tables)
    near = links(alone.select("t", "fp"), p.radius, ["t"]).select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    balls = alone.join(near, "fp", "left_semi").select("node")
    return groups, saved(groups.select("node").unionByName(balls).distinct(), "copy-met")


def _shingle_sets(met: DataFrame, texts: DataFrame, docs: DataFrame, id_col: str, text_col: str, p: CopyParams) -> DataFrame:
    """(node, shingles) of the texts that meet another, whole texts."""

    def run(batches):
        for batch in batches:
            ids, sets = [], []
            for node, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = space_words(text)
                if xxhash.xxh3_128_digest(b" ".join(words)) == key:
                    ids.append(node)
                    sets.append(shingle_set(words, p.shingle_words).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    kind = texts.schema["node"].dataType.simpleString()
    held = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("binary").alias("text"))
    rows = held.join(texts.join(met, "node").select("node", "text_key"), "node").select("node", "text_key", "text")
    return saved(rows.mapInArrow(run, f"node {kind}, shingles array<long>").dropDuplicates(["node"]), "copy-shingles")


def _prefixes(sets: DataFrame, p: CopyParams) -> DataFrame:
    """(node, n, own, prefix, common): a text's rarest shingles, of which it shares one with every near copy.

    Shingles are ordered by the texts that have them. ``own`` counts those of no other text, which come first;
    ``prefix`` holds the others up to the 1 - similarity share plus one; ``common`` is the mean of the counts.
    Texts without any prefix can't have a near copy and are left out.
    """
    items = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = saved(items.groupBy("s").agg(F.count("*").alias("texts")).where("texts > 1"), "copy-shared")
    ranked = items.join(shared, "s").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("texts", "s"))).alias("ranked"), (F.sum("texts") / F.first("n")).alias("common")
    )
    own = F.col("n") - F.size("ranked")
    length = F.col("n") - F.ceil(F.col("n") * p.similarity - 1e-9) + 1 - own
    prefix = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), length).cast("int"))["s"]
    return saved(ranked.select("node", "n", own.alias("own"), prefix.alias("prefix"), "common").where(F.size("prefix") > 0), "copy-prefixes")


def _central_pairs(groups: DataFrame, prefixes: DataFrame, p: CopyParams) -> DataFrame:
    """(a, b, na, nb) of each text and the most central one of each of its groups, that with the commonest shingles.

    They join most of a large group at the cost of one comparison a text; they don't decide any other pair.
    """
    rows = groups.join(prefixes.select("node", "n", "common"), "node")
    heads = rows.groupBy("t", "fp").agg(F.max(F.struct("common", "node", "n")).alias("h")).select("t", "fp", "h.node", "h.n")
    # Written first, so that a large group isn't bound to the task that found its head: the join can split it.
    heads = saved(heads, "copy-heads")
    both = rows.drop("common").join(heads.select("t", "fp", F.col("node").alias("b"), F.col("n").alias("nb")), ["t", "fp"])
    both = both.where((F.col("node") != F.col("b")) & _sizes_allow(F.col("n"), F.col("nb"), p))
    return both.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()


def _sizes_allow(na, nb, p: CopyParams):
    return F.least(na, nb) >= F.greatest(na, nb) * p.similarity - 1e-9


def _remaining_pairs(prefixes: DataFrame, joined: DataFrame, p: CopyParams) -> DataFrame:
    """(a, b, na, nb): every pair not ``joined(node, component)`` yet that can have the similarity."""
    known = prefixes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tokens = known.select("node", "n", "own", "component", F.posexplode("prefix").alias("at", "s"))
    tokens = saved(tokens.select("node", "n", "component", "s", (F.col("own") + F.col("at")).alias("at")), "copy-tokens")
    # A shingle whose texts are all joined already has no pair to give.
    mixed = tokens.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("s")
    live = saved(tokens.join(mixed, "s"), "copy-live")
    side = lambda x: live.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "at")])
    both = side("a").join(side("b"), "s").where("node_a < node_b and component_a <> component_b")
    both = both.where(_sizes_allow(F.col("n_a"), F.col("n_b"), p))
    # At the first common shingle, what follows it on either side bounds the rest of the intersection.
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = both.where(most >= (F.col("n_a") + F.col("n_b")) * (p.similarity / (1 + p.similarity)) - 1e-6)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, p: CopyParams) -> DataFrame:
    """The pairs whose shingle sets have the similarity, by exact intersection."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= (F.col("na") + F.col("nb") - common) * p.similarity).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: CopyParams = CopyParams()) -> DataFrame:
    """(id, component_id) of every row: groups linked by equal words or by ``similarity`` of their shingles.

    Copies collapse to one text before any fingerprint is shuffled. Among the texts that meet any other in a
    ball, all pairs of the similarity are found, by an exact join on rare shingles, and verified against their
    whole shingle sets. That a near copy meets any text at all has a high probability that grows with the
    similarity; it isn't certain. Null and wordless texts are copies of each other. A null id names no
    component: rows of a text without any other id have a null one. Rows that repeat an id are one document.
    """
    fps = saved(copy_fingerprints(docs, id_col, text_col, p), "copy-fingerprints")
    firsts = [F.first(f"f{t}").alias(f"f{t}") for t in range(p.tables)]
    texts = saved(fps.groupBy("text_key").agg(F.min("id").alias("node"), F.first("n").alias("n"), *firsts), "copy-texts")
    usable = texts.where("node is not null")
    groups, met = _meetings(usable.where("n > 0"), p)
    sets = _shingle_sets(met, usable, docs, id_col, text_col, p)
    prefixes = _prefixes(sets, p)
    central = saved(_central_pairs(groups, prefixes, p), "copy-central")
    forget(groups, met)
    near = saved(_verified(central, sets, p), "copy-links")
    found = connected_components(near)
    remaining = saved(_remaining_pairs(prefixes, found, p), "copy-remaining")
    more = saved(_verified(remaining, sets, p), "copy-links")
    forget(central, remaining, prefixes, sets)
    if not more.isEmpty():
        found = connected_components(near.unionByName(more))
    named = texts.join(found, "node", "left").select("text_key", F.coalesce("component", "node").alias("component_id"))
    return fps.select("id", "text_key").join(named, "text_key").select("id", "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: CopyParams = CopyParams(), null_ids: bool = False
) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, once; its columns unchanged.

    Rows that repeat an id with another text are documents of their own. Rows with a null id are left out, or
    with ``null_ids`` come after all others: one stays only if no document of its group has an id.
    """
    # Nulls come first in an order, so rows without an id are told apart by a field of their own.
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.withColumn("__key", key if null_ids else F.when(F.col(id_col).isNotNull(), key))
    found = near_copies(keyed, "__key", text_col, p)
    keep = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("__id")).distinct()
    kept = keyed.join(keep, F.col("__key") == F.col("__id"), "left_semi")
    return kept.dropDuplicates(["__key"]).select(*docs.columns)


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

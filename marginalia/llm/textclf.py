"""A linear text classifier over selected character n-grams, fitted on a bounded sample of labelled rows.

Features are binary: a text has a feature if any of its words has it, wherever it stands. Words are runs
without ASCII space; a word's features are the word and the 4- and 5-grams of its bytes between end marks.
Only features whose presence differs significantly between classes are kept, so that the thousands of
ordinary words of a long text add no noise to its score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, space_words

_KEPT_WORDS = 200_000
_CHUNK = 1 << 20


#: Least significance of a feature that fills up to ``least_features``.
LEAST_Z = 2.0


@dataclass(frozen=True)
class FitParams:
    #: Bound of the labelled sample: rows with the smallest hashes of their ids.
    max_fit_rows: int = 20_000
    min_docs: int = 5
    #: Least deviation, in standard errors, of a feature's log-odds between a class and the rest.
    min_z: float = 5.0
    #: Features that are used in any case, the clearest first; 0: min_z alone decides.
    least_features: int = 0
    l2: float = 1e-4
    #: Weight of the squared score changes under counterfactual swaps.
    counterfactual: float = 1.0
    #: The fit ends once its objective, a mean log loss, is proven to be this close to the least one.
    tolerance: float = 1e-3
    #: Also swap terms that the labelled table shows to stand in like contexts. They needn't name any group.
    mine_swaps: bool = False
    #: Words that lean to a class by this many standard errors, but occur with every class in ``swap_docs``
    #: rows at least, are terms that may be swapped for those of like contexts.
    swap_z: float = 2.0
    swap_docs: int = 2
    #: Least cosine of the neighbours' counts of two terms that are swapped.
    swap_likeness: float = 0.5


def word_features(word: bytes) -> tuple[bytes, ...]:
    marked = b"<" + word + b">"
    grams = {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
    grams.add(marked)
    return tuple(grams)


class Featurizer:
    """All features of texts, with the features of frequent words kept."""

    def __init__(self):
        self._kept: dict[bytes, tuple] = {}

    def word(self, word: bytes) -> tuple:
        found = self._kept.get(word)
        if found is None:
            found = word_features(word)
            if len(word) <= 64:
                if len(self._kept) >= _KEPT_WORDS:
                    self._kept.clear()
                self._kept[word] = found
        return found

    def text(self, words: list[bytes]) -> set:
        return set().union(*map(self.word, set(words)))


class _GramTable:
    """Finds byte n-grams of one width (4 or 5) in a text by a hash table; grams whose slots are taken go to a further one."""

    def __init__(self, grams: dict[bytes, int], width: int, factor: int = 0x9E3779B1):
        own = {g: i for g, i in grams.items() if len(g) == width}
        self.width, self.ids = width, np.array(list(own.values()), np.int64)
        self.head = np.array([int.from_bytes(g[:4], "little") for g in own], np.uint32)
        self.tail = np.array([g[-1] for g in own], np.uint8)
        for tries in range(24):
            self.bits, self.factor = 16 + tries // 4, factor
            slots, first = np.unique(self._slots(self.head, self.tail), return_index=True)
            factor = (factor * 0x85EBCA6B + 2) & 0xFFFFFFFF | 1
            if len(slots) == len(own):
                break
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slots] = first
        placed = set(first.tolist())
        left = {g: own[g] for i, g in enumerate(own) if i not in placed}
        self.further = left and _GramTable(left, width, factor)

    def _slots(self, head, tail):
        mixed = head * np.uint32(self.factor)
        if self.width == 5:
            mixed = (mixed ^ (tail * np.uint32(0xC2B2AE35))) * np.uint32(self.factor)
        return mixed >> np.uint32(32 - self.bits)

    def mark(self, head, tail, present) -> None:
        """Set ``present`` at the number of every gram among (first four bytes, last byte)."""
        at = self.table[self._slots(head, tail)]
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        same = (self.head[at] == head[hit]) & (self.tail[at] == tail[hit])
        present[self.ids[at[same]]] = True
        if self.further:
            self.further.mark(head, tail, present)


class FeatureFinder:
    """The features of a vocabulary that a text has, as sorted numbers; the same as Featurizer's, by arrays.

    Words are set apart by a line feed, which no word holds, so no gram reaches over two words.
    """

    def __init__(self, vocabulary: dict[bytes, int]):
        self.size = max(vocabulary.values(), default=-1) + 1
        self.words = {g[1:-1]: i for g, i in vocabulary.items() if len(g) not in (4, 5)}
        self.known = set(self.words)
        self.four, self.five = (_GramTable(vocabulary, n) for n in (4, 5))

    def text(self, words: list[bytes]) -> np.ndarray:
        present = np.zeros(self.size, bool)
        for w in self.known.intersection(words):
            present[self.words[w]] = True
        flat = np.frombuffer(b"<" + b">\n<".join(words) + b">", np.uint8)
        for at in range(0, len(flat) - 3, _CHUNK):
            part = flat[at : at + _CHUNK + 4]
            head = np.ndarray(len(part) - 3, "<u4", part.tobytes(), strides=(1,)).copy()
            self.four.mark(head[:_CHUNK], part[3 : 3 + _CHUNK], present)
            self.five.mark(head[: len(part) - 4], part[4:], present)
        return np.flatnonzero(present)


@dataclass
class Model:
    classes: list[str]
    vocabulary: dict[bytes, int]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    #: Labelled rows that hold a swappable term, and the groups of terms they were swapped within.
    swapped_rows: int = 0
    swap_groups: tuple[tuple[str, ...], ...] = ()

    def scorer(self):
        features, w, b = FeatureFinder(self.vocabulary), self.weights, self.bias

        def score(words: list[bytes]) -> np.ndarray:
            if not len(b):
                return b
            z = b + w[features.text(words)].sum(axis=0)
            e = np.exp(z - z.max())
            return e / e.sum()

        return score


class Swapper:
    """Replaces identity terms by the next term of their group; ``groups`` lists interchangeable terms."""

    def __init__(self, groups: list[list[str]]):
        self.next: dict[bytes, bytes] = {}
        for g in groups:
            terms = [t.encode() for t in g]
            self.next |= {a: b for a, b in zip(terms, terms[1:] + terms[:1])}

    def swaps(self, words: list[bytes], most: int = 2):
        """Up to ``most`` variants of the words, none if no identity term occurs."""
        at = [(i, core) for i, core in enumerate(map(_core, words)) if _lower(core) in self.next]
        current = {i: _lower(core) for i, core in at}
        for _ in range(most if at else 0):
            current = {i: self.next[c] for i, c in current.items()}
            out = list(words)
            for i, core in at:
                out[i] = words[i].replace(core, current[i])
            yield out


_AROUND = re.compile(r"^[\W_]+|[\W_]+$")


def _core(word: bytes) -> bytes:
    """The word without what isn't a letter or digit at its ends, typographic quotes and the like included."""
    if word.isalnum():
        return word
    return _AROUND.sub("", word.decode(errors="surrogateescape")).encode(errors="surrogateescape")


def _lower(core: bytes) -> bytes:
    """Lower case beyond A-Z, which words have lost already."""
    return core if core.isascii() else core.decode(errors="surrogateescape").lower().encode(errors="surrogateescape")


def labelled_sample(docs: DataFrame, labels: DataFrame, p: FitParams, id_col="doc_id", text_col="text") -> DataFrame:
    """(text, label) of the sample; copies of a text with the same label count once.

    ``labels(id_col, label)``: null ids and labels are ignored.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull())
        .select(F.col(id_col).alias("__id"), "label")
        .orderBy(F.xxhash64("__id"), "__id", "label")
        .limit(p.max_fit_rows)
    )
    # Bounded by max_fit_rows ids, so it may be broadcast; the texts stay where they are.
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).where(F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("binary").alias("text"), "label")
    return saved(rows.withColumn("h", F.sha1("text")).dropDuplicates(["h", "label"]).drop("h"), "labelled-sample")


def count_features(sample: DataFrame, counts: dict[str, int], p: FitParams) -> DataFrame:
    """(feature, n, c0, c1, ..., z0, z1, ...), counted over the whole sample by Spark: rows with the feature, in

    all and for each class, and how far its log-odds between a class and the rest deviate, in standard errors.
    """
    classes = sorted(counts)

    def run(batches):
        features, seen = Featurizer(), {c: Counter() for c in classes}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(features.text(space_words(text)))
        for c, n in seen.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(n), pa.binary()), pa.array([c] * len(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                    names=["feature", "label", "n"],
                )

    rows = sample.mapInArrow(run, "feature binary, label string, n long")
    per = rows.groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)]
    )
    total = sum(counts.values())
    zs = []
    for i, c in enumerate(classes):
        a, b = F.col(f"c{i}") + 0.5, F.col("n") - F.col(f"c{i}") + 0.5
        without_a, without_b = counts[c] - F.col(f"c{i}") + 0.5, total - counts[c] - (F.col("n") - F.col(f"c{i}")) + 0.5
        zs.append(F.abs(F.log(a / without_a) - F.log(b / without_b)) / F.sqrt(1 / a + 1 / b + 1 / without_a + 1 / without_b))
    kept = per.where(F.col("n") >= p.min_docs).select("*", *[z.alias(f"z{i}") for i, z in enumerate(zs)])
    least = min(p.min_z, p.swap_z, LEAST_Z) if p.least_features else min(p.min_z, p.swap_z)
    return saved(kept.where(F.greatest(*[f"z{i}" for i in range(len(zs))]) >= least), "features")


def select_features(counted: DataFrame, sample: DataFrame, n_classes: int, p: FitParams) -> tuple[list[bytes], np.ndarray]:
    """Features of at least ``min_z``, however many, and the number of each one's group.

    If they are fewer than ``least_features``, the clearest ones down to LEAST_Z fill up to that number, so that a
    small labelled table is not left without any.

    Features of a group occur in the same rows, as a 64-bit digest of the rows tells, so they share a column
    of the fit.
    """
    z = F.greatest(*[f"z{i}" for i in range(n_classes)])
    found = counted.where(z >= p.min_z).select("feature")
    clearest = counted.orderBy(z.desc(), "feature").limit(p.least_features).select("feature") if p.least_features else found
    names = sorted({bytes(r[0]) for rows in (found, clearest) for r in rows.collect()})
    vocabulary = {f: i for i, f in enumerate(names)}

    def run(batches):
        finder, digest = FeatureFinder(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest[finder.text(space_words(text))] ^= row
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(digest), dtype=np.int32)), pa.array(digest)], names=["f", "digest"])

    rows = sample.select("text", F.xxhash64("text", "label")).mapInArrow(run, "f int, digest long")
    rows = rows.groupBy("f").agg(F.bit_xor("digest").alias("digest")).toArrow()
    digest = np.zeros(len(names), np.int64)
    digest[rows["f"].to_numpy()] = rows["digest"].to_numpy()
    return names, np.unique(digest, return_inverse=True)[1]


_CONTEXT_SLOTS = 256


def swappable_terms(counted: DataFrame, sample: DataFrame, n_classes: int, p: FitParams) -> list[list[str]]:
    """Pairs of terms of the labelled table that stand in like contexts and occur with every class.

    They lean to a class without being proof of it, as names of groups do in toxic texts. Contexts are the
    words before and after, counted in hashed slots; each term is paired with the most alike one, if that
    holds both ways. All of it is over the bounded sample.
    """
    spread = F.least(*[f"c{i}" for i in range(n_classes)]) >= p.swap_docs
    lean = F.greatest(*[f"z{i}" for i in range(n_classes)]) >= p.swap_z
    words = F.col("feature").startswith(F.lit(b"<")) & F.col("feature").endswith(F.lit(b">"))
    terms = sorted(bytes(r[0])[1:-1] for r in counted.where(spread & lean & words).select("feature").collect())
    at = {t: i for i, t in enumerate(terms)}
    if len(at) < 2:
        return []

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = space_words(text)
                for i, w in enumerate(words):
                    if w in at:
                        if i:
                            seen[at[w], zlib.crc32(words[i - 1]) % _CONTEXT_SLOTS] += 1
                        if i + 1 < len(words):
                            seen[at[w], _CONTEXT_SLOTS + zlib.crc32(words[i + 1]) % _CONTEXT_SLOTS] += 1
        keys = list(seen)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [seen[k] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "slot", "n"])

    rows = sample.mapInArrow(run, "term long, slot long, n long").groupBy("term", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(terms), 2 * _CONTEXT_SLOTS), np.float32)
    counts[rows["term"].to_numpy(), rows["slot"].to_numpy()] = np.sqrt(rows["n"].to_numpy())
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    best, alike = np.zeros(len(terms), np.int64), np.zeros(len(terms))
    for i in range(len(terms)):
        like = counts @ counts[i]
        like[i] = -1
        best[i], alike[i] = like.argmax(), like.max()
    pairs = [(i, int(j)) for i, j in enumerate(best) if i < j and best[j] == i and alike[i] >= p.swap_likeness]
    return [[t.decode(errors="replace") for t in (terms[i], terms[j])] for i, j in pairs]


def fit(
    docs: DataFrame, labels: DataFrame, groups: list[list[str]] | None = None, p: FitParams = FitParams(), id_col="doc_id", text_col="text"
) -> Model:
    """Fit on at most ``max_fit_rows`` labelled rows.

    ``groups`` are interchangeable terms; with ``mine_swaps`` those that ``swappable_terms`` finds in the sample
    are added. None swaps nothing. One class only: it gets probability 1. No labelled rows: a model
    without classes, whose probabilities are empty.
    """
    sample = labelled_sample(docs, labels, p, id_col, text_col)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    if len(classes) < 2:
        return Model(classes, {}, np.zeros((0, len(classes))), np.zeros(len(classes)))
    counted = count_features(sample, counts, p)
    names, column = select_features(counted, sample, len(classes), p)
    if groups is not None and p.mine_swaps:
        given = {t for g in groups for t in g}
        groups = [*groups, *(g for g in swappable_terms(counted, sample, len(classes), p) if not given & set(g))]
    vocabulary = {f: i for i, f in enumerate(names)}
    at = {c: i for i, c in enumerate(classes)}

    def run(batches):
        features, swapper = FeatureFinder(vocabulary), Swapper(groups or [])
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = space_words(text)
                own = features.text(words)
                rows.append((at[label], np.unique(column[own]).tolist(), []))
                own = set(own.tolist())
                for other in swapper.swaps(words):
                    new = set(features.text(other).tolist())
                    # A swap that changes no feature counts as well: it is a row whose score keeps still.
                    rows.append((-1, sorted(new - own), sorted(own - new)))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], ints), pa.array([r[2] for r in rows], ints)],
                names=["y", "plus", "minus"],
            )

    # At most max_fit_rows rows and a swap or two of each.
    found = sample.mapInArrow(run, "y int, plus array<int>, minus array<int>").toArrow()
    weights, bias = _optimise(found, column, len(classes), p)
    swapped = int((found["y"].to_numpy() < 0).sum())
    return Model(classes, vocabulary, weights, bias, swapped, tuple(map(tuple, groups or [])))


def _entries(lists: pa.ChunkedArray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every entry of the lists at ``keep``, rows numbered from 0."""
    lists = lists.take(pa.array(keep)).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), lists.flatten().to_numpy()


_BLOCK = 1024


def _block(rows: np.ndarray, cols: np.ndarray, n: int, n_features: int):
    """Products of a 0-1 matrix, and of its transpose, with matrices of few columns."""
    if 16 * len(rows) < n * n_features:
        times = lambda w: np.stack([np.bincount(rows, w[cols, k], n) for k in range(w.shape[1])], axis=1)
        back = lambda e: np.stack([np.bincount(cols, e[rows, k], n_features) for k in range(e.shape[1])], axis=1)
        return times, back
    full = np.zeros((n, n_features), np.uint8)
    full[rows, cols] = 1
    return lambda w: (full.astype(np.float32) @ w.astype(np.float32)).astype(np.float64), lambda e: full.T.astype(np.float32) @ e.astype(np.float32)


def _optimise(found: pa.Table, column: np.ndarray, n_classes: int, p: FitParams):
    """Softmax regression with an L2 penalty and squared logit changes under swaps, by L-BFGS.

    k features of one column have equal weights v at the optimum. They are fitted as one weight sqrt(k) v,
    whose penalty is theirs.
    """
    scale = np.sqrt(np.bincount(column))
    n_features = len(scale)
    y = found["y"].to_numpy()
    example, swap = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    y, n, m = y[example], len(example), len(swap)
    # Blocks of rows bound what a step holds besides. Sparse ones are entries, dense ones a byte a feature.
    blocks = [_block(*_entries(found["plus"], example[at : at + _BLOCK]), min(_BLOCK, n - at), n_features) for at in range(0, n, _BLOCK)]
    parts = [_entries(found[c], swap) for c in ("plus", "minus")]
    s_rows, s_cols = (np.concatenate([q[i] for q in parts]) for i in range(2))
    s_cols, s_sign = column[s_cols], np.repeat([1.0, -1.0], [len(q[0]) for q in parts]) / scale[column[s_cols]]
    b0 = np.log(np.bincount(y, minlength=n_classes) / n)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        x = x.reshape(n_features + 1, n_classes)
        w, b = x[:-1], x[-1]
        own_scale, g, loss = w * scale[:, None], p.l2 * (x - np.vstack([np.zeros_like(w), b0])), 0.0
        for (times, back), at in zip(blocks, range(0, n, _BLOCK)):
            own = y[at : at + _BLOCK]
            z = times(own_scale) + b
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            every = e.sum(1, keepdims=True)
            each = np.arange(len(own))
            loss += (np.log(every[:, 0]) - z[each, own]).sum()
            e /= every
            e[each, own] -= 1
            g[:-1] += scale[:, None] * back(e) / n
            g[-1] += e.sum(0) / n
        loss = loss / n + 0.5 * p.l2 * (w * w).sum() + 0.5 * p.l2 * ((b - b0) ** 2).sum()
        for k in range(n_classes if m else 0):
            change = np.bincount(s_rows, s_sign * w[s_cols, k], m)
            loss += p.counterfactual / m * (change @ change)
            g[:-1, k] += 2 * p.counterfactual / m * np.bincount(s_cols, s_sign * change[s_rows], n_features)
        return loss, g.ravel()

    x = least(value, np.concatenate([np.zeros(n_features * n_classes), b0]), p.l2, p.tolerance).reshape(n_features + 1, n_classes)
    return (x[:-1] / scale[:, None])[column], x[-1]


def least(value, x: np.ndarray, curvature: float, tolerance: float, memory: int = 12) -> np.ndarray:
    """Where a function with at least this curvature everywhere is within ``tolerance`` of its minimum (L-BFGS).

    The gradient bounds the distance: it is at most g.g / (2 curvature). RuntimeError if no step gets nearer.
    """
    f, g = value(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(5000):
        if g @ g <= 2 * curvature * tolerance:
            return x
        q, used = g.copy(), []
        for s, d, r in reversed(moves):
            a = (s @ q) / r
            used.append(a)
            q -= a * d
        q *= moves[-1][2] / (moves[-1][1] @ moves[-1][1]) if moves else min(1.0, 1 / np.linalg.norm(g))
        for (s, d, r), a in zip(moves, reversed(used)):
            q += (a - (d @ q) / r) * s
        slope, size = -(g @ q), 1.0
        while size > 1e-12:
            new = x - size * q
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * size * slope + 1e-7 * abs(f):
                break
            size /= 2
        else:
            raise RuntimeError(f"the fit found no step down at a gradient of {np.linalg.norm(g)}")
        s, d = new - x, g_new - g
        if s @ d > 1e-12:
            moves = [*moves[1 - memory :], (s, d, s @ d)]
        x, f, g = new, f_new, g_new
    raise RuntimeError(f"the fit did not settle: gradient {np.linalg.norm(g)}")


def probabilities(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, n_tokens, probability per class as an array in the order of ``model.classes``), whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features that the bounded sample proves

    def run(batches):
        score = shared.value.scorer()
        for batch in batches:
            n, out = [], []
            for text in batch.column(1).to_pylist():
                words = space_words(text)
                n.append(len(words))
                out.append(score(words).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["id", "n_tokens", "p"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, p array<double>").withColumnRenamed("id", id_col)

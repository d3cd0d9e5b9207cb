"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds to them.

A token is a word or one other character. It is known by its shape (kind of letters, length), by its cue word if it
is one, and by whether it touches the token before; so are its neighbours up to REACH tokens away on the same line.
The field is fitted to a small labelled table, with lines of the corpus beside it that carry base matches as labels
and are plain otherwise. Tokens and features are numpy arrays over many texts at once.

Decoding is exact. A token that no stretch of marked tokens can hold with a gain over plain ones is plain on the best
path, so Viterbi runs over what is left in between, many stretches at a time. Line ends are plain.

Null and empty texts have no spans. Rows stay rows, whatever their ids; other columns are ignored. Memory is that of
CHUNK characters, or of the longest line where that is longer.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_examples

#: Order of kinds among spans that begin together; the base rules find the first four.
KINDS = ("email", "ip", "card", "phone", "name", "address", "id")
BASE_KINDS = KINDS[:4]
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(_DOUBLED[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the domain behind it and the run before it, no further back than the last match. Linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        while found and start > done and text[start - 1] in _LOCAL:
            start -= 1
        if found and start < at:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base rules, in code points; matches that fail their check are dropped."""
    spans: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=_by_start)


def _by_start(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# Tokens and their shapes, as arrays.

REACH = 3
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _MARK = range(6)
_LENGTHS = np.digitize(np.arange(64), [2, 3, 4, 5, 7, 10, 13, 17]).astype(np.int32)  # 9 classes
_N_MARKS = 130  # the ASCII characters, all others, line ends
N_SHAPES = _N_MARKS + 6 * 9
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(32)], np.uint64)
_tables: list[np.ndarray] = []


def _characters() -> list[np.ndarray]:
    """Class and lower case of the first 65,536 code points; the last entry stands for all beyond."""
    if not _tables:
        kind, low = np.full(65536, _MARK, np.uint8), np.arange(65536, dtype=np.uint64)
        for i in range(65535):
            c = chr(i)
            if c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
                kind[i] = _LINE
            elif c.isspace():
                kind[i] = _SPACE
            elif "0" <= c <= "9":
                kind[i] = _DIGIT
            elif c.isalnum() or unicodedata.category(c)[0] == "M":
                kind[i] = _UPPER if c.isupper() else _LOWER
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
        kind[65535] = _LOWER
        _tables.extend((kind, low))
    return _tables


def _hashes(cp: np.ndarray, starts: np.ndarray, word: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.append(starts, len(cp)))
    place = np.arange(starts[0], len(cp)) - np.repeat(starts, lengths)
    part = _characters()[1][cp[starts[0] :]] * _POWERS[np.minimum(place, 31)]
    part[~word[starts[0] :]] = 0
    return np.add.reduceat(part, starts - starts[0])


@dataclass
class Tokens:
    """Tokens of a text, each line end repeated REACH times and as many around all, so that no line sees another."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    hash: np.ndarray
    glued: np.ndarray
    line: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def tokenize(text: str) -> Tokens:
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
    kind = _characters()[0][cp]
    word = (kind >= _LOWER) & (kind <= _DIGIT)
    after = np.zeros(len(cp), bool)  # a word character stands before
    after[1:] = word[:-1]
    starts = np.flatnonzero((word & ~after) | (kind == _MARK) | (kind == _LINE))
    if not len(starts):
        starts = np.zeros(0, np.int64)
    is_word = word[starts]
    ends = starts + 1
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends[is_word] = np.flatnonzero(last) + 1
    if len(starts):
        count = lambda k: np.add.reduceat((kind == k).astype(np.int32), starts)
        upper, digit = count(_UPPER), count(_DIGIT)
        size = ends - starts
        form = np.select(
            [digit == size, digit > 0, upper == 0, (upper == size) & (size > 1), (upper == 1) & (kind[starts] == _UPPER)], [0, 1, 2, 3, 4], 5
        )
        mark = np.where(kind[starts] == _LINE, 129, np.minimum(cp[starts], 128))
        shape = np.where(is_word, _N_MARKS + form * 9 + _LENGTHS[np.minimum(size, 63)], mark).astype(np.int32)
        hashed = _hashes(cp, starts, word)
    else:
        shape, hashed = np.zeros(0, np.int32), np.zeros(0, np.uint64)
    glued = np.zeros(len(starts), np.int32)
    line = shape == 129
    glued[1:] = (starts[1:] == ends[:-1]) & ~line[1:] & ~line[:-1]
    at = np.repeat(np.arange(len(starts)), np.where(line, REACH, 1))
    pad = lambda x, v: np.concatenate((np.full(REACH, v, x.dtype), x[at], np.full(REACH, v, x.dtype)))
    return Tokens(pad(starts, 0), pad(ends, 0), pad(shape, 129), pad(hashed, 0), pad(glued, 0), pad(line, True))


def _hash_word(word: str) -> int:
    return sum(ord(c) * int(p) for c, p in zip(word, _POWERS)) % (1 << 64)


@dataclass
class Model:
    """Emission weights of (feature, label), transitions, and the cue words' hashes in order."""

    cues: np.ndarray
    emit: np.ndarray
    trans: np.ndarray
    labels: tuple[str, ...]

    def features(self, t: Tokens) -> np.ndarray:
        """One row of feature numbers for each token but the padding's."""
        at = np.minimum(np.searchsorted(self.cues, t.hash), len(self.cues) - 1)
        cue = np.where((self.cues[at] == t.hash) & (t.shape >= _N_MARKS), at + 1, 0).astype(np.int32)
        inside = len(t) - 2 * REACH
        out, base = [], 0
        for off in range(-REACH, REACH + 1):
            here = slice(REACH + off, REACH + off + inside)
            out.append(base + t.shape[here])
            base += N_SHAPES
            out.append(base + cue[here])
            base += len(self.cues) + 1
        for off in (0, 1):
            out.append(base + t.glued[REACH + off : REACH + off + inside])
            base += 2
        return np.stack(out, 1)

    @staticmethod
    def n_features(n_cues: int) -> int:
        return (2 * REACH + 1) * (N_SHAPES + n_cues + 1) + 4


def label_names(kinds=KINDS) -> tuple[str, ...]:
    return ("O", *[f"{b}-{k}" for k in kinds for b in "BI"])


def emissions(model: Model, features: np.ndarray) -> np.ndarray:
    out = model.emit[features[:, 0]]
    for c in range(1, features.shape[1]):
        out += model.emit[features[:, c]]
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of stretches (n, longest, labels) that stand between plain tokens; longer ones first."""
    n, longest, k = scores.shape
    best = scores[:, 0] + trans[0]
    back = np.zeros((n, longest, k), np.int8)
    final = np.empty((n, k))
    for t in range(1, longest + 1):
        live = int(np.searchsorted(-lengths, -t))  # stretches longer than t
        final[live : len(best)] = best[live:]
        if t == longest:
            break
        step = best[:live, :, None] + trans
        back[:live, t] = step.argmax(1)
        best = np.take_along_axis(step, back[:live, t, None, :].astype(np.int64), 1)[:, 0] + scores[:live, t]
    at = (final + trans[:, 0]).argmax(1)
    out = np.zeros((n, longest), np.int8)
    rows = np.arange(n)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t))
        out[:live, t] = at[:live]
        if t:
            at[:live] = back[rows[:live], t, at[:live]]
    return out


#: Cells (stretches times longest) that one call of viterbi holds.
_CELLS = 200_000


def _may_be_marked(emit: np.ndarray, line: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """False where a token is surely plain on the best path.

    A stretch of marked tokens between plain ones gains at most what its first token gains on entry, the others
    inside, and the exit, each with its most favourable label, over the same stretch all plain. Running sums and
    running maxima give, for each token, the best such bound of all stretches that hold it.
    """
    rest = trans - trans[0, 0]
    over = emit[:, 1:] - emit[:, :1]
    inside = (over + rest[1:, 1:].max(0).astype(np.float32)).max(1).astype(np.float64)
    entry = (over + rest[0, 1:].astype(np.float32)).max(1).astype(np.float64)
    inside[line] = entry[line] = -1e4
    total = np.cumsum(inside)
    begun = np.maximum.accumulate(entry - total)
    ended = np.maximum.accumulate(total[::-1])[::-1]
    return (begun + ended + rest[1:, 0].max() > -1e-3) & ~line


def decode(model: Model, tokens: Tokens) -> np.ndarray:
    """The best label of every token but the padding's."""
    emit = emissions(model, model.features(tokens))
    line, trans = tokens.line[REACH : len(tokens) - REACH], model.trans
    open_ = _may_be_marked(emit, line, trans)
    out = np.zeros(len(emit), np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], open_.astype(np.int8), [0]))))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    at = 0
    while at < len(starts):
        take = max(1, _CELLS // int(lengths[at]))
        s, n = starts[at : at + take], lengths[at : at + take]
        place = np.minimum(s[:, None] + np.arange(n[0]), len(emit) - 1)
        best = viterbi(emit[place].astype(np.float64), n, trans)
        inside = np.arange(n[0]) < n[:, None]
        out[place[inside]] = best[inside]
        at += take
    return out


_AT = r"(?:@|\b(?:at|arroba|arobase|ät)\b)"
_DOT = r"(?:\.|\b(?:dot|punto|punkt|point)\b)"


def _confirmed(kind: str, text: str) -> bool:
    """What a span of the kind must hold at least, whatever the model says."""
    digits, words = _digits(text), re.findall(r"[^\W_]+", text)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return text.count(":") >= 2 and len(text) >= 6 and all(re.fullmatch("[0-9A-Fa-f]{0,4}", p) for p in text.split(":"))
    if kind == "email":
        return 3 <= len(words) <= 12 and re.search(rf"\w.*{_AT}.*\w.*{_DOT}.*\w", text, re.I) is not None
    if kind == "address":
        return bool(digits) and 2 <= len(words) <= 12
    if kind == "id":
        return len(digits) >= 5
    return 1 <= len(words) <= 6 and len(set(words)) == len(words) and words[0][0].isupper()


def model_spans(model: Model, text: str) -> list[Span]:
    """Spans of the model alone over text that may join many texts by line ends."""
    if not text:
        return []
    tokens = tokenize(text)
    label = decode(model, tokens)
    kind = (label + 1) // 2  # 0: plain
    if not kind.any():
        return []
    first = kind > 0
    first[1:] &= (label[1:] % 2 == 1) | (kind[1:] != kind[:-1])
    starts = np.flatnonzero(first)
    stop = (kind == 0) | first
    ends = np.searchsorted(np.flatnonzero(stop), starts, side="right")
    stops = np.append(np.flatnonzero(stop), len(kind))[ends]
    begin, end = tokens.start[REACH:][starts], tokens.end[REACH:][stops - 1]
    names = [model.labels[2 * k].split("-")[1] for k in kind[starts]]
    return [(k, int(a), int(b)) for k, a, b in zip(names, begin, end) if _confirmed(k, text[a:b])]


#: Characters of text that are tokenised together; texts longer than this are cut at line ends.
CHUNK = 400_000


def _chunks(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(joined text, [(start, number of the text, where in it)]) over all texts, in bounded pieces."""
    parts, places, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= CHUNK else text.find("\n", at + CHUNK)
            end = len(text) if end < 0 else end
            if size and size + end - at > CHUNK:
                yield "\n".join(parts), places
                parts, places, size = [], [], 0
            parts.append(text[at:end])
            places.append((size, i, at))
            size += end - at + 1
            at = end + 1 if end < len(text) else end
    if parts:
        yield "\n".join(parts), places


def find_spans(model: Model, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, all spans) of each text; model spans that overlap a base span are dropped."""
    base = [base_spans(t) for t in texts]
    every = [list(b) for b in base]
    for joined, places in _chunks(texts):
        begins = np.array([p[0] for p in places])
        for kind, a, b in model_spans(model, joined):
            start, i, at = places[int(np.searchsorted(begins, a, side="right")) - 1]
            span = (kind, a - start + at, b - start + at)
            if not any(x[1] < span[2] and span[1] < x[2] for x in base[i]):
                every[i].append(span)
    return base, [sorted(x, key=_by_start) for x in every]


# Fitting.


@dataclass(frozen=True)
class FitParams:
    l2: float = 0.3
    steps: int = 120
    background_lines: int = 800  # lines of the corpus beside the labelled table, at most
    background_docs: int = 400  # documents they are taken from, at most
    line_tokens: int = 60  # longer lines aren't taken


def _gold(tokens: Tokens, spans: list[Span], labels: tuple[str, ...]) -> np.ndarray:
    at = {x: i for i, x in enumerate(labels)}
    start, end = tokens.start[REACH : len(tokens) - REACH], tokens.end[REACH : len(tokens) - REACH]
    out = np.zeros(len(start), np.int64)
    for kind, a, b in spans:
        inside = np.flatnonzero((start >= a) & (end <= b))
        out[inside] = at[f"I-{kind}"]
        out[inside[:1]] = at[f"B-{kind}"]
    return out


class _Objective:
    """Mean negative log-likelihood with an L2 term, and its gradient, over padded sequences."""

    def __init__(self, features: list[np.ndarray], gold: list[np.ndarray], n_features: int, n_labels: int, l2: float):
        order = np.argsort([-len(g) for g in gold], kind="stable")
        self.lengths = np.array([len(gold[i]) for i in order])
        self.n, self.longest, self.k, self.f, self.l2 = len(order), int(self.lengths[0]), n_labels, n_features, l2
        self.inside = np.arange(self.longest) < self.lengths[:, None]
        self.gold = np.zeros((self.n, self.longest), np.int64)
        for row, i in enumerate(order):
            self.gold[row, : len(gold[i])] = gold[i]
        stacked = np.concatenate([features[i] for i in order])
        self.columns = []
        for c in range(stacked.shape[1]):
            by = np.argsort(stacked[:, c], kind="stable")
            ids, first = np.unique(stacked[by, c], return_index=True)
            self.columns.append((stacked[:, c], by, ids, first))
        flat = self.gold[self.inside]
        self.truth = np.zeros((len(flat), self.k))
        self.truth[np.arange(len(flat)), flat] = 1
        before = np.concatenate((np.zeros((self.n, 1), np.int64), self.gold), 1)[:, : self.longest][self.inside]
        self.pairs = np.zeros((self.k, self.k))
        np.add.at(self.pairs, (before, flat), 1)
        np.add.at(self.pairs, (self.gold[np.arange(self.n), self.lengths - 1], np.zeros(self.n, np.int64)), 1)

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        with np.errstate(all="ignore"):  # a step too far gives no number, and the search goes back
            return self._value(w)

    def _value(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        emit_w, trans = w[: self.f * self.k].reshape(self.f, self.k), w[self.f * self.k :].reshape(self.k, self.k)
        flat = sum(emit_w[ids] for ids, *_ in self.columns)
        gain = float((flat * self.truth).sum() + (trans * self.pairs).sum())
        top = flat.max(1, keepdims=True)
        e = np.zeros((self.n, self.longest, self.k))
        e[self.inside] = np.exp(flat - top)
        t_max = trans.max()
        t = np.exp(trans - t_max)
        live = [int(np.searchsorted(-self.lengths, -i)) for i in range(self.longest)]  # sequences longer than i
        alpha, norm = np.zeros_like(e), np.ones((self.n, self.longest))
        for i in range(self.longest):
            a = (t[0] if i == 0 else alpha[: live[i], i - 1] @ t) * e[: live[i], i]
            norm[: live[i], i] = a.sum(1)
            alpha[: live[i], i] = a / norm[: live[i], i, None]
        last = alpha[np.arange(self.n), self.lengths - 1]
        ending = last @ t[:, 0]
        z = float(np.log(norm).sum() + np.log(ending).sum() + top.sum() + t_max * (self.lengths.sum() + self.n))
        beta = np.zeros_like(e)
        beta[np.arange(self.n), self.lengths - 1] = t[:, 0] / ending[:, None]
        expected = np.zeros((self.k, self.k))
        expected[:, 0] += (last * t[:, 0] / ending[:, None]).sum(0)
        for i in range(self.longest - 1, 0, -1):
            right = e[: live[i], i] * beta[: live[i], i] / norm[: live[i], i, None]
            expected += t * (alpha[: live[i], i - 1].T @ right)
            beta[: live[i], i - 1] = right @ t.T
        right = e[:, 0] * beta[:, 0] / norm[:, :1]
        expected[0] += t[0] * right.sum(0)
        diff = (alpha * beta)[self.inside] - self.truth
        grad = np.zeros((self.f, self.k))
        for _, by, ids, first in self.columns:
            grad[ids] += np.add.reduceat(diff[by], first, axis=0)
        g = np.concatenate((grad.ravel(), (expected - self.pairs).ravel()))
        return (z - gain + 0.5 * self.l2 * float(w @ w)) / self.n, (g + self.l2 * w) / self.n


def lbfgs(objective, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    value, grad = objective(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, coef = grad.copy(), []
        for s, y, r in reversed(past):
            coef.append(r * (s @ q))
            q -= coef[-1] * y
        if past:
            s, y, r = past[-1]
            q *= 1 / (r * (y @ y))
        for (s, y, r), c in zip(past, reversed(coef)):
            q += s * (c - r * (y @ q))
        slope, rate = float(grad @ q), 1.0 if past else min(1.0, 1 / (np.abs(grad).sum() + 1e-12))
        while True:
            new = w - rate * q
            new_value, new_grad = objective(new)
            if new_value <= value - 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, y = new - w, new_grad - grad
        if float(s @ y) > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / float(s @ y))]
        done = abs(value - new_value) <= 1e-6 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def fit(rows: list[tuple[str, list[Span]]], cues: list[str], params: FitParams = FitParams(), kinds=KINDS) -> Model:
    """A model from (text, spans) rows, one line each."""
    labels = label_names(kinds)
    hashes = np.unique(np.array([_hash_word(c) for c in cues], np.uint64))
    model = Model(hashes, np.zeros(0), np.zeros(0), labels)
    features, gold = [], []
    for text, spans in rows:
        tokens = tokenize(text)
        if len(tokens) > 2 * REACH:
            features.append(model.features(tokens))
            gold.append(_gold(tokens, spans, labels))
    f, k = Model.n_features(len(hashes)), len(labels)
    w = lbfgs(_Objective(features, gold, f, k, params.l2), np.zeros(f * k + k * k), params.steps)
    return Model(hashes, w[: f * k].reshape(f, k).astype(np.float32), w[f * k :].reshape(k, k), labels)


def background_rows(docs: DataFrame, params: FitParams = FitParams(), text_col: str = "text") -> list[tuple[str, list[Span]]]:
    """Lines of a bounded sample of documents (those of the smallest hashes), labelled by the base rules."""
    short = F.col(text_col).isNotNull() & (F.length(text_col) <= 100 * params.line_tokens)
    texts = docs.where(short).select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    least = [r.h for r in texts.select("h").distinct().orderBy("h").limit(params.background_docs).collect()]
    sample = texts.where(F.col("h").isin(least)).groupBy("h").agg(F.min("t").alias("t"))
    rows = []
    for r in sorted(sample.collect()):
        for line in r.t.split("\n"):
            if line.strip() and len(rows) < params.background_lines and len(tokenize(line)) <= params.line_tokens + 2 * REACH:
                rows.append((line, base_spans(line)))
    return rows


def fit_corpus(docs: DataFrame, params: FitParams = FitParams(), text_col: str = "text") -> Model:
    """The production model: the built-in labelled table, and bounded background of ``docs``."""
    return fit(pii_examples.labelled_rows() + background_rows(docs, params, text_col), pii_examples.cue_words(), params)


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) of every row; spans are (kind, start, end) by start and kind, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in batches:
            base, every = find_spans(model, [t or "" for t in batch.column(1).to_pylist()])
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in rows], _SPAN_TYPE) for rows in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "base", "spans"])

    kind, spans = docs.schema[id_col].dataType.simpleString(), "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the digest of them, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact_text(text: str | None, spans: list[Span]) -> str | None:
    """Each span as its kind in angle brackets; where spans overlap, the first and all that it meets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=_by_start):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by ``<kind>``; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            _, spans = find_spans(shared.value, [t or "" for t in texts])
            text = pa.array([redact_text(t, s) for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()

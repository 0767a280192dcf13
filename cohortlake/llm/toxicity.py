"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Two strings are similar by their common subsequences of three letters, each weighted by a power of its
span in both, so letters that are inserted, doubled or pulled apart cost a little and do not hide a word.
The kernel is taken to a few landmark words and whitened (Nystroem), and a linear support vector machine
separates toxic from clean labelled texts, each represented by its worst word under the machine before (a
multiple-instance machine). The first one starts from the words that mark toxic texts, with altered spellings of
them. Every word whose excess in toxic texts is significant is a landmark; beyond ``GROUP`` of
them each group has a machine of its own. A document's margin is that of its worst word under the harshest machine.

A machine's weights over all landmarks add up to one weight per letter triple, so a word of any spelling is
scored by its own triples, however many landmarks there are, and no word is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns, flat, smallest, text_of
from cohortlake.session import settle

DECAY = 0.6
LONGEST = 32  # longer words are scored in overlapping parts
LEARN_ROWS = (6000, 3000)  # labelled rows of label 0 and 1 to learn from, those of the smallest hash
GROUP, COMMON = 256, 128  # landmarks of either kind in one machine
FALSE = 0.01  # expected part of the markers that mark toxic texts by chance only
ROUNDS = 3  # machines fitted one after the other, each on the worst words of the labelled texts under the one before
LOWEST = -1.5  # margin of texts without a word
BANDS, PER_BAND, ALIKE = 10, 3, 0.5  # near copies among the labelled rows: minima of word triples, part of them equal
REMEMBERED = 400_000
_SPACED = re.compile(r"(?<!\S)\w(?:[\s.*_-]+\w(?!\w)){2,}")
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_RUN = re.compile(r"[^\W\d_]+")
_KNOWN: dict = {}


def subsequence_kernel(words: list[str], marks: list[str], decay: float = DECAY) -> np.ndarray:
    """Kernel of order 3 between all words and marks, for words of one common length."""
    if not words or not marks:
        return np.zeros((len(words), len(marks)))
    letters = {c: i for i, c in enumerate(sorted({c for m in marks for c in m}))}
    wide = max(map(len, marks))
    table = np.zeros((len(letters) + 1, len(marks), wide), np.float32)
    for j, m in enumerate(marks):
        for p, c in enumerate(m):
            table[letters[c], j, p] = decay**2
    far = np.subtract.outer(np.arange(wide), np.arange(wide))  # to - from
    step = np.where(far > 0, decay ** np.maximum(far - 1, 0), 0).T.astype(np.float32)
    codes = np.array([[letters.get(c, len(letters)) for c in w] for w in words])
    one = np.zeros((len(words), len(marks), wide), np.float32)
    two, total = np.zeros_like(one), np.zeros((len(words), len(marks)))
    for p in range(codes.shape[1]):
        here = table[codes[:, p]]
        total += (here * (two @ step)).sum(axis=2)
        two = decay * two + here * (one @ step)
        one = decay * one + here
    return total


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one common length, a row per word."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def self_kernel(words: list[str], decay: float = DECAY) -> np.ndarray:
    """Kernel of every word with itself, for words of one common length."""
    n = len(words[0])
    codes = letters_of(words)
    far = np.subtract.outer(np.arange(n), np.arange(n))
    step = np.where(far > 0, decay ** np.maximum(far - 1, 0), 0).T
    one = np.zeros((len(words), n))
    two, total = np.zeros_like(one), np.zeros(len(words))
    for p in range(n):
        here = (codes == codes[:, p : p + 1]) * decay**2
        total += (here * (two @ step)).sum(axis=1)
        two = decay * two + here * (one @ step)
        one = decay * one + here
    return total


def similarity(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel, 0 to 1; words of fewer than three letters are like nothing."""
    own = np.array([self_kernel([m])[0] for m in marks])
    out = np.zeros((len(words), len(marks)))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, at in groups.items():
        if n < 3:
            continue
        most = max(50, min(1000, 50_000 // max(1, len(marks))))
        for a in range(0, len(at), most):
            part = at[a : a + most]
            group = [words[i] for i in part]
            out[part] = subsequence_kernel(group, marks) / np.sqrt(np.outer(self_kernel(group), own))
    return out


class Machine:
    """Linear machine on the whitened kernel features, folded into a weight per letter triple."""

    def __init__(self, landmarks: list[str], whiten: np.ndarray, weights: np.ndarray, bias: float):
        self.landmarks, self.bias = landmarks, bias
        self.letters = {c: i for i, c in enumerate(sorted(set().union(*landmarks)))}
        share = whiten @ weights
        size = len(self.letters) + 1  # the last stands for all other letters
        pairs: dict[tuple[int, int], int] = {}
        found: list[tuple[int, int, float]] = []
        for mark, x in zip(landmarks, share, strict=True):
            codes = [self.letters[c] for c in mark]
            x /= np.sqrt(self_kernel([mark])[0])
            for i, j, k in combinations(range(len(codes)), 3):
                found.append((pairs.setdefault((codes[i], codes[j]), len(pairs) + 1), codes[k], x * DECAY ** (k - i + 1)))
        self.pair = np.zeros((size, size), np.int64)  # where the weights of a pair begin; 0: a pair that no landmark holds
        for (first, second), row in pairs.items():
            self.pair[first, second] = row * size
        self.table = np.zeros((len(pairs) + 1) * size)
        rows, last, x = zip(*found, strict=True)
        np.add.at(self.table, np.array(rows) * size + np.array(last), x)

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; words of fewer than three letters have the lowest."""
        out = np.full(len(words), LOWEST)
        size = len(self.letters) + 1
        known = np.array([ord(c) for c in self.letters], np.uint32)  # in order of code points
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for n, at in groups.items():
            for a in range(0, len(at) if n > 2 else 0, 2048):
                part = at[a : a + 2048]
                same = [words[i] for i in part]
                points = letters_of(same)
                near = np.minimum(np.searchsorted(known, points), size - 2)
                codes = np.where(known[near] == points, near, size - 1)
                total = np.zeros(len(part))
                for i in range(n - 2):
                    for j in range(i + 1, n - 1):
                        rows = self.pair[codes[:, i], codes[:, j]]
                        total += self.table.take(rows[:, None] + codes[:, j + 1 :]) @ (DECAY ** (np.arange(j + 1, n) - i + 1.0))
                out[part] = np.maximum(total / np.sqrt(self_kernel(same)) + self.bias, LOWEST)
        return out


@dataclass
class Model:
    markers: list[str]
    machines: list[Machine]
    middle: float = 0.0
    slope: float = 4.0

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word under the machine that gives it most."""
        return np.max([m.margins(words) for m in self.machines], axis=0)


def forms(token: str) -> set[str]:
    """Readings of a token between white space: its runs of letters, all its letters, and with figures read as letters."""
    if token.isalpha():
        if len(token) <= LONGEST:
            return {token}
        found = {token}
    else:
        runs = _RUN.findall(token)
        found = {*runs, "".join(runs)}
        if runs and (plain := token.translate(_PLAIN)) != token:
            found.add("".join(_RUN.findall(plain)))
    out = set()
    for f in found:
        out.update([f] if len(f) <= LONGEST else [f[a : a + LONGEST] for a in range(0, len(f) - LONGEST // 2, LONGEST // 2)])
    return out


def tokens(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    if _SPACED.search(low):
        found.update("".join(_RUN.findall(m[0])) for m in _SPACED.finditer(low))
    return found


def _texts(batch: pa.RecordBatch) -> list[str]:
    data, at = flat(batch.column("body"))
    whole = data.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class _Worst:
    """Margin of the worst token of a text, with its spelling if asked; each distinct token of a worker is scored once."""

    def __init__(self, model: Model, spelled: bool):
        self.model, self.spelled, self.known = model, spelled, {}

    def of(self, texts: list[str]) -> list:
        found = [tokens(t) for t in texts]
        new = set().union(*found).difference(self.known)
        if len(new) + len(self.known) > REMEMBERED:
            self.known, new = {}, set().union(*found)
        readings = {t: forms(t) for t in new}
        words = list(set().union(*readings.values()))
        values = self.model.margins(words).tolist()
        margin = dict(zip(words, zip(values, words, strict=True) if self.spelled else values, strict=True))
        least = (LOWEST, "") if self.spelled else LOWEST
        for t, r in readings.items():
            self.known[t] = max(map(margin.__getitem__, r), default=least)
        return [max(map(self.known.__getitem__, f), default=least) for f in found]


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hashes of the word triples of each text."""
    from xxhash import xxh3_64_intdigest

    turn = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, BANDS * PER_BAND, np.uint64) | np.uint64(1)
    for batch in by_bytes(batches, "body", 4 << 20):
        texts = _texts(batch)
        least = []
        for text in texts:
            h = np.array([xxh3_64_intdigest(w.encode()) for w in text.lower().split()], np.uint64)
            triples = h[:-2] * np.uint64(3) ^ h[1:-1] * np.uint64(5) ^ h[2:] * np.uint64(7) if len(h) > 2 else h[:1] + h[-1:]
            triples ^= triples >> np.uint64(29)
            least.append([int((triples * t).min() >> np.uint64(1)) for t in turn] if len(triples) else None)
        ids = [xxh3_64_intdigest(t.encode()) >> 1 for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=["id", "least"])


def near_copies(rows: list[tuple[int, list[int]]]) -> dict[int, int]:
    """The group of each text: texts that share a band and ``ALIKE`` of their minima are near copies."""
    group = {i: i for i, _ in rows}

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    buckets: dict[tuple, list[tuple[int, np.ndarray]]] = {}
    for i, least in sorted(rows):
        own = np.array(least)
        for b in range(BANDS):
            inside = buckets.setdefault((b, *least[b * PER_BAND : (b + 1) * PER_BAND]), [])
            for j, other in inside:
                if top(i) != top(j) and np.mean(own == other) >= ALIKE:
                    group[max(top(i), top(j))] = min(top(i), top(j))
            if all(top(i) != top(j) for j, _ in inside):
                inside.append((i, own))
    return {i: top(i) for i in group}


def _words_by_label(groups: dict[int, int]):
    """Distinct words of each text with the group of its near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in by_bytes(batches, "body", 4 << 20):
            labels, keys, words = [], [], []
            for label, text in zip(batch.column("label").to_pylist(), _texts(batch), strict=True):
                own = {w for w in _RUN.findall(text.lower()) if 3 <= len(w) <= LONGEST}
                key = groups.get(xxh3_64_intdigest(text.encode()) >> 1)
                if own and key is not None:
                    labels += [label] * len(own)
                    keys += [key] * len(own)
                    words += own
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["label", "key", "word"])

    return run


def _altered(word: str, rng: np.random.Generator) -> list[str]:
    """Spellings with a letter inserted or doubled."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = [word[:i] + letters[rng.integers(26)] + word[i:] for i in range(1, len(word))]
    return out + [word[:i] + word[i - 1] + word[i:] for i in range(1, len(word) + 1)]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    cost = lambda v: 0.5 * ridge.diagonal() @ v**2 + c * weight @ np.maximum(0, 1 - y * (a @ v)) ** 2
    for _ in range(100):
        on = y * (a @ w) < 1
        h = ridge + 2 * c * (a[on] * weight[on, None]).T @ a[on]
        step, size = np.linalg.solve(h, 2 * c * (a[on] * weight[on, None]).T @ y[on]) - w, 1.0
        while size > 1e-6 and cost(w + size * step) > cost(w):  # full steps can go round in circles
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    return w[:-1], float(w[-1])


def excess(bad: int, fine: int, n: dict[int, int]) -> float:
    """Probability that ``bad`` or more of the texts with a word are toxic by chance (hypergeometric)."""
    pick = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    total = n[0] + n[1]
    have = min(bad + fine, total)
    return min(1.0, sum(exp(pick(have, i) + pick(total - have, n[1] - i) - pick(total, n[1])) for i in range(bad, min(have, n[1]) + 1) if n[1] - i <= total - have))


def significant(pairs: list[tuple[int, int, int]], n: dict[int, int], tests: int) -> list[tuple[int, int]]:
    """Pairs of counts (toxic, clean) with a significant excess, of (toxic, clean, words with these counts).

    Benjamini and Hochberg's procedure over ``tests`` words; ``FALSE`` of those found are expected to be there by chance.
    """
    ranked = sorted((excess(bad, fine, n), bad, fine, words) for bad, fine, words in pairs)
    found = np.cumsum([words for *_, words in ranked])
    last = max((i for i, (x, *_) in enumerate(ranked) if x * tests <= FALSE * found[i]), default=-1)
    return [(bad, fine) for _, bad, fine, _ in ranked[: last + 1]]


def _fit(markers: list[str], often: list[str], good: list[str], fine: list[str]) -> Machine:
    landmarks = similarity(markers + often, markers + often)
    values, vectors = np.linalg.eigh(landmarks + 1e-6 * np.eye(len(landmarks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = similarity(good + fine, markers + often) @ whiten
    y = np.concatenate([np.ones(len(good)), -np.ones(len(fine))])
    weight = np.concatenate([np.full(len(good), 1 / len(good)), np.full(len(fine), 1 / len(fine))]) * len(y) / 2
    return Machine(markers + often, whiten, *_svm(x, y, weight))


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", order: Column | None = None, rows: tuple[int, int] = LEARN_ROWS, seed: int = 5) -> Model | None:
    """Fit on a bounded sample of labelled rows: at most ``rows`` per label, those of the smallest ``order``.

    Rows of equal order count once. Of the words that stand in toxic texts significantly more often than in clean ones,
    those whose texts are toxic more often than not, at the labels' rates in all rows, are the markers, however rare beside
    others; near copies of a text count once. The machine is then fitted ``ROUNDS`` times to the worst words of the
    labelled texts. None when no word marks toxic texts.
    """
    check_columns(labelled, text_col, label_col)
    order = F.xxhash64(F.col(f"`{text_col}`")) if order is None else order
    known = labelled.select(F.col(f"`{label_col}`").cast("long").alias("label"), text_of(labelled, text_col).alias("body"), order.cast("long").alias("_at")).where("label in (0, 1)")
    last, total = smallest(known, "label", "_at", {0: rows[0], 1: rows[1]})
    if set(last) != {0, 1}:
        return None
    inside = ((F.col("label") == 0) & (F.col("_at") <= F.lit(last[0]))) | ((F.col("label") == 1) & (F.col("_at") <= F.lit(last[1])))
    sample = settle(known.where(inside).dropDuplicates(["label", "_at"]).select("label", "body"), "toxic-sample")
    minima = sample.mapInArrow(_minima, "id long, least array<long>").where("least is not null").distinct().collect()  # a row per sampled text
    groups = near_copies([(r["id"], r["least"]) for r in minima])
    spoken = settle(sample.mapInArrow(_words_by_label(groups), "label long, key long, word string"), "toxic-words")
    n = {r["label"]: r["n"] for r in spoken.groupBy("label").agg(F.count_distinct("key").alias("n")).collect()}
    if set(n) != {0, 1}:
        return None
    mine = lambda v: F.count_distinct(F.when(F.col("label") == v, F.col("key")))
    counted = settle(spoken.groupBy("word").agg(mine(1).alias("bad"), mine(0).alias("fine")), "toxic-counts")
    mostly = F.col("bad") / n[1] * total[1] > F.col("fine") / n[0] * total[0]
    far = counted.where((F.col("bad") > 0) & mostly)
    pairs = [(r["bad"], r["fine"], r["words"]) for r in far.groupBy("bad", "fine").agg(F.count("*").alias("words")).collect()]  # a row per pair of counts
    kept = significant(pairs, n, counted.count())
    if not kept:
        return None
    marked = far.join(labelled.sparkSession.createDataFrame(kept, "bad long, fine long"), ["bad", "fine"])
    markers = [r["word"] for r in marked.orderBy(F.desc(F.col("bad") / n[1] - F.col("fine") / n[0]), "word").select("word").collect()]
    clean = counted.where(F.col("fine") > 0).join(marked.select("word"), "word", "left_anti")
    start = {r["word"] for r in clean.orderBy(F.xxhash64("word", F.lit(seed))).select("word").limit(sum(rows) // 3).collect()}
    often = [r["word"] for r in clean.orderBy(F.desc("fine"), "word").select("word").limit(COMMON).collect()]
    rng = np.random.Generator(np.random.PCG64(seed))
    parts = [markers[a : a + GROUP] for a in range(0, len(markers), GROUP)]
    altered = {m: _altered(m, rng) for m in markers}
    fine, good, model = set(start), [set() for _ in parts], None
    for turn in range(ROUNDS):
        model = Model(markers, [_fit(g, often, sorted((set(g).union(*[altered[m] for m in g]) | more) - fine), sorted(fine)) for g, more in zip(parts, good, strict=True)])
        worst = sample.mapInArrow(_margins(model, "label", spelled=True), "label long, margin double, worst string")
        seen = [(r["label"], r["margin"], r["worst"]) for r in worst.collect()]  # a row per sampled text
        if turn < ROUNDS - 1:  # the words that decide the labelled texts; a marker stays one in spite of single clean texts
            fine |= {w for label, x, w in seen if label == 0 and x > -1 and len(w) > 2} - set(markers)
            caught = sorted({w for label, x, w in seen if label == 1 and x > 0})
            if caught:  # each goes to the machine that gives it most
                for w, at in zip(caught, np.argmax([m.margins(caught) for m in model.machines], axis=0), strict=True):
                    good[at].add(w)
            alike = Counter(w for label, x, w in seen if label == 0 and x > 0 and len(w) > 2 and w not in markers)
            often = list(dict.fromkeys([w for w, _ in sorted(alike.items(), key=lambda y: (-y[1], y[0]))[: COMMON // 2]] + often))[:COMMON]
    seen = np.array([(label, x) for label, x, _ in seen])
    bad, ok = np.sort(seen[seen[:, 0] == 1, 1]), np.sort(seen[seen[:, 0] == 0, 1])
    own = np.sort(model.margins(markers))
    edges = np.unique(np.concatenate([seen[:, 1], own]))
    if len(edges) > 1:
        # the cut with the fewest wrong labels; of equal ones with the fewest markers below, then in the widest gap, nearer to the clean texts
        cuts = edges[:-1] + 0.35 * np.diff(edges)
        wrong = np.searchsorted(bad, cuts) + len(ok) - np.searchsorted(ok, cuts) + np.searchsorted(own, cuts) / (len(own) + 1)
        best = np.flatnonzero(wrong == wrong.min())
        model.middle = float(cuts[best[np.argmax(np.diff(edges)[best])]])
    return model


def _margins(model: Model, key: str, spelled: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (spelled, tuple(model.markers), *(m.bias for m in model.machines))
        if name not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[name] = _Worst(model, spelled)
        for batch in by_bytes(batches, "body", 1 << 20):
            worst = _KNOWN[name].of(_texts(batch))
            margins = [x for x, _ in worst] if spelled else worst
            out = {key: batch.column(key), "margin": pa.array(margins, pa.float64())}
            if spelled:
                out["worst"] = pa.array([w for _, w in worst], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1, 0.5 at the learned cut), predicted (1 from 0.5 on).

    Whole texts are read. Null and empty texts get the score of a text without any word; without a
    model every score is 0. Repeated rows get equal scores; an empty table gives an empty table.
    """
    check_columns(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = rows.mapInArrow(_margins(model, "id"), "id long, margin double")
    value = 1 / (1 + F.exp(F.lit(-model.slope) * (F.col("margin") - F.lit(model.middle))))
    return scored.select(F.col("id").alias(id_col), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))

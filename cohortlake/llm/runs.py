"""Periodic runs of words by a sparse diagonal dynamic program.

Two words that are ``lag`` places apart and equal lengthen the match of that lag's diagonal by one; where
they differ, the diagonal ends, and a match that is long enough is a run of that period. A run of period q
and length L is a match of L - q words on diagonal q, and L >= 2q means at least q of them in a row. So
diagonals are taken an octave of lags at a time, lags A to 2A - 1, and a word's earlier occurrences count only
where the A words from there on are equal too: shorter matches cannot become runs. The few lags that
this leaves active are extended word by word to both ends and given out when they end; the lags
below twelve are compared directly.

Texts that repeat a short period many times would make every pair of occurrences active. A gram of A
words inside a run of a period up to A / 2 that was found in an earlier octave is known to match at that
run's multiples; if it lies deeper than one period inside, it is paired with grams near the ends of such
runs only, as a diagonal that joins the insides of two runs always reaches one of their ends. With that the
pairs of an octave stay in proportion to the words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns, flat, text_of
from cohortlake.llm.shingles import scrambled

SHORTEST = 12  # words of the shortest run
BATCH_BYTES = 2 << 20
_WINDOW = 256  # words compared at a time when a match is extended
_PRIMES: dict[int, list[int]] = {}


def numbered(texts: Iterator[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number per word, equal for equal words of one text and different between texts, and where texts begin."""
    ids, begins, base = [], [0], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
        begins.append(len(ids))
    return np.array(ids, np.int64), np.array(begins, np.int64)


def _extended(w: np.ndarray, low: int, high: int, x: int, lag: int, width: int) -> tuple[int, int]:
    """First and last word of the match of ``lag`` that holds words x to x + width - 1, inside words low to high - 1."""
    a, step = x, _WINDOW
    while a > low:
        n = min(step, a - low)
        differ = np.flatnonzero(w[a - n : a] != w[a - n + lag : a + lag])
        if len(differ):
            a += int(differ[-1]) + 1 - n
            break
        a, step = a - n, step * 2
    b, step = x + width, _WINDOW
    while b < high - lag:
        n = min(step, high - lag - b)
        differ = np.flatnonzero(w[b : b + n] != w[b + lag : b + lag + n])
        if len(differ):
            b += int(differ[0])
            break
        b, step = b + n, step * 2
    return a, b - 1 + lag


def _factors(n: int) -> list[int]:
    """The prime factors of n, each once."""
    if n not in _PRIMES:
        found, rest, p = [], n, 2
        while p * p <= rest:
            if rest % p == 0:
                found.append(p)
                while rest % p == 0:
                    rest //= p
            p += 1
        _PRIMES[n] = found + ([rest] if rest > 1 else [])
    return _PRIMES[n]


def _smallest(w: np.ndarray, start: int, lag: int) -> bool:
    """Whether no part of ``lag`` is a period too; the words from start on repeat with ``lag`` at least twice."""
    return not any(np.array_equal(w[start : start + lag], w[start + lag // p : start + lag + lag // p]) for p in _factors(lag))


def _pairs(keys: np.ndarray, at: np.ndarray, inside: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of equal keys, octave <= y - x < 2 * octave, not both ``inside`` a run. ``at`` ascends."""
    order = np.argsort(keys, kind="stable")
    key, place, deep = keys[order], at[order], inside[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    # places of one group ascend; groups lie more than two octaves apart on this line
    line = group * (int(place.max()) + 4 * octave) + place
    open_ = np.flatnonzero(~deep)
    found = []
    for low, high, forward in ((octave, 2 * octave - 1, True), (1 - 2 * octave, -octave, False)):
        first = np.searchsorted(line, line[open_] + low, "left")
        n = np.searchsorted(line, line[open_] + high, "right") - first
        total = int(n.sum())
        if not total:
            continue
        other = np.arange(total) + np.repeat(first - (np.cumsum(n) - n), n)
        own = np.repeat(open_, n)
        if not forward:
            keep = deep[other]  # pairs of two open ones are found forward
            other, own = other[keep], own[keep]
        x, y = (own, other) if forward else (other, own)
        found.append((place[x], place[y]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(w: np.ndarray, begins: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in the numbered words of many texts; ends are one past the last word.

    A run is a stretch with smallest period q and length >= max(shortest, 2q) that no neighbouring word extends.
    """
    n, runs = len(w), []
    for lag in range(1, min(shortest, n)):
        need = max(shortest - lag, lag)
        edges = np.concatenate([[-1], np.flatnonzero(w[:-lag] != w[lag:]), [n - lag]])
        for k in np.flatnonzero(np.diff(edges) > need):
            a, b = int(edges[k]) + 1, int(edges[k + 1]) + lag
            if _smallest(w, a, lag):
                runs.append((a, b, lag))
    octave = shortest
    if n < 2 * octave:
        return runs
    at = np.arange(n - octave + 1)
    grams = np.zeros(len(at), np.uint64)
    for k in range(octave):
        grams = scrambled(grams + np.uint64(1)) + w[k : k + len(at)].astype(np.uint64)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    while True:
        whole = text[at] == text[at + octave - 1]
        at, grams = at[whole], grams[whole]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at, grams = at[again], grams[again]
        if not len(at):
            return runs
        owner, deep = np.full(n, -1, np.int64), np.zeros(n, bool)
        for k, (a, b, q) in enumerate(runs):
            if 2 * q <= octave and b - a >= octave:
                owner[a : b - octave + 1] = k
                deep[a + q : max(a + q, b - octave + 1 - q)] = True
        x, y = _pairs(grams, at, deep[at], octave)
        known = (owner[x] >= 0) & (owner[x] == owner[y])
        x, lag = x[~known], (y - x)[~known]
        order = np.lexsort((x, lag, text[x]))
        last = (-1, -1, -1)  # text, lag and end of the match extended last
        for p, d in zip(x[order].tolist(), lag[order].tolist(), strict=True):
            t = int(text[p])
            if (t, d) == last[:2] and p < last[2]:
                continue
            low, high = int(begins[t]), int(begins[t + 1])
            if not np.array_equal(w[p : p + octave], w[p + d : p + d + octave]):
                continue  # equal hashes of different words
            a, b = _extended(w, low, high, p, d, octave)
            last = (t, d, b + 1 - d)
            if b + 1 - a >= 2 * d and _smallest(w, a, d):
                runs.append((a, b + 1, d))
        # grams of twice the words begin where both their halves recur
        place = np.searchsorted(at, at + octave)
        place[place == len(at)] = 0
        there = at[place] == at + octave
        grams, at = scrambled(grams[there] * np.uint64(3) + np.uint64(octave)) + grams[place[there]], at[there]
        octave *= 2
        if not len(at):
            return runs


def repeated_tail(words: list, doc: int | None) -> list:
    """The words with a periodic tail, for each id whose unsigned crc32 is a multiple of ten."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * times + words[a : a + rest]


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    runs = sorted((a, b - a, q) for a, b, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for a, size, q in runs:
            cover[a + q] += 1
            cover[a + size] -= 1
        words = [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
    listed = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *head, listed, b" ".join(words)


_OUT = "n_runs long, start long, length long, period long, exponent_milli long"
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def _scan(planted: bool, digests: bool):
    names = ["id", *[c.split()[0] for c in _OUT.split(", ")], *(("runs_sha256", "collapsed_sha256") if digests else ("runs", "collapsed"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "body", BATCH_BYTES):
            data, at = flat(batch.column("body"))
            body, docs = data.tobytes(), batch.column("id").to_pylist()
            texts = [body[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if planted:
                texts = [repeated_tail(t, d) for t, d in zip(texts, docs, strict=True)]
            w, begins = numbered(iter(texts))
            own: dict[int, list] = {}
            found = find_runs(w, begins)
            for (a, b, q), t in zip(found, (np.searchsorted(begins, [r[0] for r in found], "right") - 1).tolist(), strict=True):
                own.setdefault(t, []).append((a - int(begins[t]), b - int(begins[t]), q))
            rows = []
            for t, words in enumerate(texts):
                *numbers, listed, kept = _summary(words, own.get(t, []))
                ends = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()) if digests else (listed, kept.decode())
                rows.append((docs[t], *numbers, *ends))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, the longest run (start, length, period, exponent_milli), runs, collapsed.

    Words stand between ASCII white space. ``runs`` lists all runs, ``start,length,period`` a line by start and
    period; ``collapsed`` is the text without the words any run holds after its first period, joined by one space. Of
    equally long runs the one with the smallest start, then period, is named. With ``digests`` the SHA-256 of the two
    texts stand in runs_sha256 and collapsed_sha256 instead; with ``planted`` the texts first go through ``repeated_tail``.
    Null, empty and white texts have no runs and nulls for the longest. Every row is judged by itself, so null and repeated ids,
    repeated rows and columns that clash with the result are of no effect; a null id plants nothing. An empty table gives none.
    A task holds whole texts, BATCH_BYTES of them or one longer text, and works in proportion to their words.
    """
    check_columns(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    last = "runs_sha256 string, collapsed_sha256 string" if digests else "runs string, collapsed string"
    found = rows.mapInArrow(_scan(planted, digests), f"id long, {_OUT}, {last}")
    return found.withColumnRenamed("id", id_col)

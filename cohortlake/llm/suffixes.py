"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``depth`` bytes only, by most-significant-digit passes; suffixes still equal then
start with the same repeated string, and each group of equals knows its smallest document.

The first digit deals suffixes to tasks. It is a function of the same ``depth`` bytes: the smallest hash among
the grams inside them. Neighbouring suffixes mostly share it, so a run of them travels as one string of
depth + run - 1 bytes. Before any text moves, the digits alone are counted, and runs whose digit no second
document has are done. The passes that follow, five bytes each, run inside the tasks, and leave out at once what
is alone or in one document. Answers return as one bit per suffix.

Documents are packed into blocks once, written to the shared folder. Equal runs of a block travel once, so a string
that a third of all documents hold costs a row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import check_columns, flat, text_of
from cohortlake.llm.shingles import scrambled
from cohortlake.session import settle

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20  # text per group of the first digit
SLICE = 2 << 20
NO_ID = np.iinfo(np.int64).max
_RNG = np.random.Generator(np.random.PCG64(50))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Scrambled hash of the ``size`` bytes at every place, put together from halves."""
    level, width, done, have = _BYTE[data], 1, None, 0
    rest = size
    while rest:
        if rest & 1:
            if done is None:
                done, have = level, width
            else:
                n = len(data) - have - width + 1
                done = done[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + level[have : have + n]
                have += width
        rest >>= 1
        if rest:
            n = len(level) - width
            level = level[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + level[width : width + n]
            width *= 2
    return scrambled(done)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def runs(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes with one first digit: first and last place, digit, document number.

    Suffixes shorter than ``depth`` are left out, so no run reaches over the end of a document.
    """
    gram = max(1, depth // 2)
    firsts, lasts, digits = [], [], []
    total = len(data) - depth + 1
    for s in range(0, max(0, total), SLICE):
        n = min(SLICE, total - s)
        digit = _least(gram_hashes(data[s : s + n + depth - 1], gram), depth - gram + 1)
        place = np.arange(s, s + n)
        whole = place + depth <= at[np.searchsorted(at, place, "right")] if len(at) > 2 else np.ones(n, bool)
        begin, end = whole.copy(), whole.copy()
        new = digit[1:] != digit[:-1]
        begin[1:] &= ~whole[:-1] | new
        end[:-1] &= ~whole[1:] | new
        first = np.flatnonzero(begin)
        firsts.append(first + s)
        lasts.append(np.flatnonzero(end) + s)
        digits.append(scrambled(digit[first]))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate(firsts)
    return first, np.concatenate(lasts), np.concatenate(digits), np.searchsorted(at, first, "right") - 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks of about BLOCK_BYTES, one document at least."""
    task, number = TaskContext.get().partitionId(), 0
    ids, parts, size = [], [], 0

    def block() -> pa.RecordBatch:
        whole = b"".join(parts)
        at = np.cumsum([0, *map(len, parts)]).astype(np.int64)
        packed = zstandard.ZstdCompressor(level=3).compress(whole)
        columns = [pa.array([(task << 32) + number]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([at.tobytes()]), pa.array([packed], pa.binary()), pa.array([len(whole)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "at", "body", "size"])

    for batch in batches:
        data, at = flat(batch.column("body"))
        for doc, a, b in zip(batch.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            ids.append(NO_ID if doc is None else doc)
            parts.append(data[a:b].tobytes())
            size += b - a
            if size >= BLOCK_BYTES or len(ids) >= 100_000:
                yield block()
                ids, parts, size, number = [], [], 0, number + 1
    if ids:
        yield block()


def _open(body: bytes, size: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, size)), np.uint8)


def _by_bucket(digit: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digits ordered by (bucket, digit): digits, buckets, edges of the buckets, order of all digits."""
    bucket = (digit % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((digit, bucket))
    own = digit[order]
    keep = np.ones(len(own), bool)
    keep[1:] = own[1:] != own[:-1]
    numbers, edges = np.unique(bucket[order][keep], return_index=True)
    return order, keep, numbers, np.append(edges, int(keep.sum()))


def _digits(depth: int, buckets: int):
    """Per block and bucket its distinct first digits, five bytes each, and whether two documents have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], np.int64)
                _, _, digit, doc = runs(_open(row["body"], row["size"]), at, depth)
                if not len(digit):
                    continue
                order, keep, numbers, edges = _by_bucket(digit, buckets)
                begin = np.flatnonzero(keep)
                stop = np.append(begin[1:], len(order)) - 1
                owner = np.frombuffer(row["ids"], np.int64)[doc]
                several = np.minimum.reduceat(owner[order], begin) != np.maximum.reduceat(owner[order], begin) if len(begin) else stop > begin
                short = (digit[order][keep] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :5]
                columns = [
                    pa.array(numbers),
                    pa.array(np.full(len(numbers), row["block"])),
                    pa.array([short[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "digits", "several"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Bits per block: which of its first digits a second document has."""
    rows = table.combine_chunks().to_pylist()
    size = [len(r["digits"]) // 5 for r in rows]
    wide = np.zeros((sum(size), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(r["digits"] for r in rows), np.uint8).reshape(-1, 5)
    _, inverse, counts = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    more = counts > 1
    ends = np.cumsum([0, *size])
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n) for r, n in zip(rows, size, strict=True)]).astype(bool)
    more[inverse[several]] = True
    found = more[inverse]
    bits = [np.packbits(found[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array(np.zeros(len(rows), np.int64)), "bits": pa.array(bits, pa.binary())})


def _strings(row: dict, marks: list[dict], depth: int, buckets: int) -> tuple:
    """A block's runs whose digit is repeated, and per bucket the distinct strings of such runs.

    Gives the bytes, offsets and ids of the documents, (first, last, document number, string number) of the
    runs, and (bucket, strings, smallest id of each) with strings numbered through all buckets.
    """
    at, ids = np.frombuffer(row["at"], np.int64), np.frombuffer(row["ids"], np.int64)
    data = _open(row["body"], row["size"])
    first, last, digit, doc = runs(data, at, depth)
    groups, chosen, number = [], [np.zeros((0, 4), np.int64)], 0
    if len(digit) and marks:
        order, keep, numbers, edges = _by_bucket(digit, buckets)
        rank = np.cumsum(keep) - 1
        bits = {m["bucket"]: m["bits"] for m in marks}
        again = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(n)).astype(bool) for b, n in zip(numbers.tolist(), np.diff(edges), strict=True)])
        place = np.searchsorted(rank, edges)  # of the buckets in ``order``
        whole = data.tobytes()
        for b, x, y in zip(numbers.tolist(), place[:-1], place[1:], strict=True):
            pick = order[x:y][again[rank[x:y]]]
            if not len(pick):
                continue
            known: dict[bytes, int] = {}
            texts = [known.setdefault(whole[f : e + depth], len(known)) for f, e in zip(first[pick].tolist(), last[pick].tolist(), strict=True)]
            least = np.full(len(known), NO_ID)
            np.minimum.at(least, texts, ids[doc[pick]])
            chosen.append(np.column_stack([first[pick], last[pick], doc[pick], np.array(texts) + number]))
            groups.append((b, list(known), least))
            number += len(known)
    return data, at, ids, np.concatenate(chosen), groups


def _send(depth: int, buckets: int):
    def run(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        out: list[dict] = []
        found = marks.to_pylist()
        for row in blocks.to_pylist():
            groups = _strings(row, found, depth, buckets)[4]
            for bucket, strings, least in groups:
                size = np.array([len(s) for s in strings], np.int64)
                packed = zstandard.ZstdCompressor(level=3).compress(b"".join(strings))
                out.append({"bucket": bucket, "block": row["block"], "sizes": zstandard.compress(size.astype(np.uint32).tobytes()), "ids": zstandard.compress(least.tobytes()), "body": packed, "size": int(size.sum())})
        return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary()), ("body", pa.binary()), ("size", pa.int64())]))

    return run


def smallest_owner(data: np.ndarray, start: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix the smallest owner among all that agree with it in ``depth`` bytes.

    Passes over digits of three or five bytes, most significant first. Each pass orders the suffixes inside the groups of
    the passes before; a suffix alone in its group, or in a group of one owner, has its answer and leaves.
    """
    best = owner.copy()
    live, group = np.arange(len(start)), np.zeros(len(start), np.uint64)
    wide = 5 if len(start) < 1 << 24 else 3  # the group's number and the digit share 64 bits
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data) + 1, np.uint64)
    for i in range(wide):
        word = (word << np.uint64(8)) | padded[i : i + len(word)]
    for at in range(0, depth, wide):
        if not len(live):
            break
        at = min(at, depth - wide) if depth >= wide else 0  # the last digit overlaps the one before
        digit = word[start[live] + at]
        if depth < wide:
            digit = digit >> np.uint64(8 * (wide - depth))
        key = (group << np.uint64(8 * wide)) | digit
        order = np.argsort(key)
        key, live = key[order], live[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least, most = np.minimum.reduceat(owner[live], begin), np.maximum.reduceat(owner[live], begin)
        size = np.diff(np.append(begin, len(live)))
        open_ = np.repeat(least != most, size)
        group = np.repeat(np.cumsum(least != most).astype(np.uint64) - np.uint64(1), size)[open_]
        live = live[open_]
    if len(live):
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        best[live] = np.repeat(np.minimum.reduceat(owner[live], begin), np.diff(np.append(begin, len(live))))
    return best


def _sort(depth: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        number: dict[bytes, int] = {}
        least: list[int] = []
        which, owners = [], []
        for r in rows:
            size = np.frombuffer(zstandard.decompress(r["sizes"]), np.uint32).astype(np.int64)
            ids = np.frombuffer(zstandard.decompress(r["ids"]), np.int64)
            whole, ends, own = _open(r["body"], r["size"]).tobytes(), np.cumsum(size).tolist(), []
            a = 0
            for b, i in zip(ends, ids.tolist(), strict=True):
                n = number.setdefault(whole[a:b], len(number))
                if n == len(least):
                    least.append(i)
                elif i < least[n]:
                    least[n] = i
                own.append(n)
                a = b
            which.append(np.array(own))
            owners.append(ids)
        data = np.frombuffer(b"".join(number), np.uint8)
        length = np.array([len(s) for s in number], np.int64)
        begin = np.cumsum(length) - length
        windows = length - depth + 1
        edge = np.concatenate([[0], np.cumsum(windows)])
        start = np.arange(edge[-1]) + np.repeat(begin - edge[:-1], windows)
        best = smallest_owner(data, start, np.repeat(np.array(least, np.int64), windows), depth)
        bits = []
        for own, ids in zip(which, owners, strict=True):
            n = windows[own]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(edge[own] - (ends - n), n)
            bits.append(np.packbits(best[at] < np.repeat(ids, n)).tobytes())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array(np.ones(len(rows), np.int64)), "bits": pa.array(bits, pa.binary())})

    return run


_RESULT = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))]
)


def _cut(depth: int, buckets: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found = answers.to_pylist()
        marks, bits = [a for a in found if a["kind"] == 0], {a["bucket"]: a["bits"] for a in found if a["kind"] == 1}
        out = []
        for row in blocks.to_pylist():
            data, at, ids, chosen, groups = _strings(row, marks, depth, buckets)
            cover = np.zeros(len(data) + 1, np.int32)
            if len(chosen):
                sizes = np.concatenate([[len(s) - depth + 1 for s in strings] for _, strings, _ in groups])
                smaller = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=sum(len(s) - depth + 1 for s in strings)) for b, strings, _ in groups])
                least = np.concatenate([low for _, _, low in groups])
                edge = np.cumsum(sizes) - sizes
                first, last, doc, string = chosen.T
                n = last - first + 1
                ends = np.cumsum(n)
                step = np.arange(ends[-1]) - np.repeat(ends - n, n)
                hit = (smaller[step + np.repeat(edge[string], n)] == 1) | np.repeat(ids[doc] > least[string], n)
                place = (step + np.repeat(first, n))[hit]
                np.add.at(cover, place, 1)
                np.add.at(cover, place + depth, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = gone[a:b]
                turn = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                kept = data[a:b][~own].tobytes()
                out.append((None if ids[i] == NO_ID else int(ids[i]), b - a, int(own.sum()), len(turn) // 2, hashlib.sha256(kept).hexdigest(), turn[::2].tolist(), turn[1::2].tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT) if out else _RESULT.empty_table()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops (of the removed spans).

    Texts are UTF-8 bytes. A byte is removed if a string of ``depth`` bytes over it also starts in a row
    with a smaller id; strings are judged on the input and lie inside one text. Null texts are empty; texts
    shorter than ``depth`` lose nothing. Rows that share an id lose nothing to one another. A null id is
    larger than all others. Texts of any length are cut into runs piece by piece. An empty table
    gives an empty table.
    """
    check_columns(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    blocks = settle(rows.mapInArrow(_pack, "block long, ids binary, at binary, body binary, size long"), "suffix-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    digits = blocks.mapInArrow(_digits(depth, buckets), "bucket long, block long, digits binary, several binary")
    answer = "block long, bucket long, kind long, bits binary"
    marks = settle(digits.groupBy("bucket").applyInArrow(_repeated, answer), "suffix-marks")
    sent = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_send(depth, buckets), "bucket long, block long, sizes binary, ids binary, body binary, size long")
    found = settle(sent.groupBy("bucket").applyInArrow(_sort(depth), answer), "suffix-answers")
    cut = blocks.groupBy("block").cogroup(marks.union(found).groupBy("block")).applyInArrow(
        _cut(depth, buckets), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>"
    )
    return cut.withColumnRenamed("id", id_col)

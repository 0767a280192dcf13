"""Exact duplicates: Patricia tries hold the distinct texts, terminal nodes their owners.

Texts are dealt by length and content hash, so equal texts meet in one task. Each task inserts the
full bytes into a compressed radix trie; a terminal node keeps the smallest and largest identifier
and a count. The same trie runs first over each input partition as a combiner, so a text that holds
a third of all rows reaches its owner task once per input partition. A trie above its memory
limit gives out all it holds and starts empty; later stages merge what was given out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import check_columns, flat, text_of
from cohortlake.session import settle

TRIE_BYTES = 64 << 20  # bytes of labels that one trie holds before subtrees are given out
NODE_BYTES = 200


class _Node:
    __slots__ = ("children", "label", "low", "high", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.low, self.high, self.count = label, None, None, None, 0


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """Compressed radix trie from byte strings to (smallest id, largest id, rows)."""

    def __init__(self):
        self.root, self.held = _Node(b""), 0

    def insert(self, key: bytes, low: int | None, high: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.held += len(child.label) + NODE_BYTES
                node = child
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = _shared(child.label, key[at : at + len(child.label)])
            upper = _Node(child.label[:cut])
            upper.children = {child.label[cut]: child}
            child.label = child.label[cut:]
            node.children[key[at]] = upper
            self.held += NODE_BYTES
            node, at = upper, at + cut
        node.count += count
        if low is not None:
            node.low = low if node.low is None else min(node.low, low)
            node.high = high if node.high is None else max(node.high, high)

    def _below(self, top: _Node) -> Iterator[tuple[bytes, _Node]]:
        stack = [(b"", top)]
        while stack:
            path, node = stack.pop()
            path += node.label
            if node.count:
                yield path, node
            stack += [(path, child) for child in (node.children or {}).values()]

    def drain(self) -> Iterator[tuple[bytes, int | None, int | None, int]]:
        """Give out and forget all subtrees, one below the root at a time."""
        for key in list(self.root.children or {}):
            for path, node in self._below(self.root.children.pop(key)):
                yield path, node.low, node.high, node.count
        if self.root.count:
            yield b"", self.root.low, self.root.high, self.root.count
        self.root, self.held = _Node(b""), 0


_PART = "n_bytes long, content_hash long, body binary, low long, high long, n long"
_OWNER = "n_bytes long, sha binary, low long, high long, n long"


def _arrow(ddl_fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(ddl_fields)


_PART_ARROW = _arrow([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])
_OWNER_ARROW = _arrow([("n_bytes", pa.int64()), ("sha", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _bodies(column: pa.Array) -> Iterator[bytes]:
    """Values in UTF-8 with A-Z lower-cased and all else untouched."""
    data, at = flat(column)
    whole = data.tobytes().lower()
    return (whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _combine(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PART_ARROW, strict=True)], schema=_PART_ARROW)

        def given() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for key, low, high, n in trie.drain():
                rows.append((len(key), _signed(xxhash.xxh3_64_intdigest(key)), key, low, high, n))
                size += len(key)
                if size > 4 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

        for batch in batches:
            for body, doc in zip(_bodies(batch.column("body")), batch.column("id").to_pylist(), strict=True):
                trie.insert(body, doc, doc, 1)
                if trie.held > limit:
                    yield from given()
        yield from given()

    return run


def _own(limit: int):
    """Rows come sorted by (length, hash): a trie is complete, and may go, whenever these change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Patricia(), None

        def given() -> Iterator[pa.RecordBatch]:
            rows = [(len(k), hashlib.sha256(k).digest(), low, high, n) for k, low, high, n in trie.drain()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OWNER_ARROW, strict=True)], schema=_OWNER_ARROW)

        for batch in batches:
            data, at = flat(batch.column("body"))
            whole = data.tobytes()
            columns = [batch.column(c).to_pylist() for c in ("n_bytes", "content_hash", "low", "high", "n")]
            for i, (size, content, low, high, n) in enumerate(zip(*columns, strict=True)):
                if trie.held > limit and (size, content) != last:
                    yield from given()
                trie.insert(whole[at[i] : at[i + 1]], low, high, n)
                last = (size, content)
        yield from given()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = list(_bodies(batch.column("body")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())],
            names=["id", "n_bytes", "sha"],
        )


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text (A-Z lower-cased): n_bytes, sha (binary), low, high (ids), n (rows)."""
    check_columns(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    parts = rows.mapInArrow(_combine(trie_bytes), _PART)
    dealt = parts.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(_own(trie_bytes), _OWNER)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the identifier that stays,
    "min" or "max". Null text counts as empty text; an empty text is a text like any other. Null ids
    are never owners unless the whole group has none; then keep_id is null and kept false. Rows that
    repeat an id count in group_size and share its ``kept``. An empty table gives an empty table;
    columns other than the two named are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    own = settle(owners(docs, id_col, text_col, trie_bytes), "text-owners").select(
        F.col("n_bytes").alias("_n"), F.col("sha").alias("_sha"), F.col("low" if keep == "min" else "high").alias("keep_id"), F.col("n").alias("group_size")
    )
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    keyed = rows.mapInArrow(_keys, "id long, n_bytes long, sha binary")
    return keyed.join(own, (F.col("sha") == F.col("_sha")) & (F.col("n_bytes") == F.col("_n"))).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

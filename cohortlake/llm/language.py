"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. An n-gram is the product
of its letters' vectors, each permuted by its place; a text is the sum of its n-grams, scaled to length
one; a language is the sum of its learned texts. A document gets the language whose prototype has the
largest cosine with the document's vector.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns, flat, smallest, text_of
from cohortlake.session import settle

DIMENSIONS = 1024
GRAM = 3
LEARN_ROWS = 2000  # labelled rows per language, those of the smallest seeded hash
REMEMBERED = 20_000  # n-gram vectors a worker holds, 4 bytes per dimension each
UNKNOWN = "und"
_GRAMS: dict = {}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter's code point, 0 for all that is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 and low.isalpha() else cp
    return table


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of letters and word ends, one per place; empty without a letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not points.any():
        return np.zeros(0, np.uint64)
    letters = np.concatenate([[0], points, [0]]).astype(np.uint64)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)  # one mark for a run of non-letters
    letters = letters[keep]
    code = np.zeros(len(letters) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(21)) | letters[i : i + len(code)]
    return code


class Grams:
    """Vectors of n-grams, made when first met."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed, self.letter = dimensions, seed, {}
        self.clear()

    def clear(self) -> None:
        self.codes, self.rows, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.table = np.zeros((256, self.dimensions), np.float32)

    def _letter(self, cp: int) -> np.ndarray:
        if cp not in self.letter:
            bits = np.random.Generator(np.random.PCG64([self.seed, cp])).integers(0, 2, self.dimensions)
            self.letter[cp] = (2 * bits - 1).astype(np.float32)
        return self.letter[cp]

    def _vector(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.float32)
        for i in range(GRAM):
            out = out * np.roll(self._letter(code >> (21 * i) & 0x1FFFFF), i)
        return out

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``table`` for sorted distinct codes."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if self.used + len(new) > max(REMEMBERED, len(codes)):
            self.clear()
            new = codes
        if len(new):
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for i, code in enumerate(new.tolist()):
                self.table[self.used + i] = self._vector(code)
            at = np.searchsorted(self.codes, new)
            self.codes, self.rows = np.insert(self.codes, at, new), np.insert(self.rows, at, np.arange(self.used, self.used + len(new)))
            self.used += len(new)
        return self.rows[np.searchsorted(self.codes, codes)]

    def bundle(self, text: str) -> np.ndarray | None:
        """Vector of a text, of length one; None without a letter."""
        codes, counts = np.unique(gram_codes(text), return_counts=True)
        if not len(codes):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for a in range(0, len(codes), REMEMBERED // 2):  # a text of very many n-grams goes in parts
            part = slice(a, a + REMEMBERED // 2)
            rows = self.rows_of(codes[part])
            out += counts[part].astype(np.float32) @ self.table[rows]
        return out / max(float(np.linalg.norm(out)), 1e-9)


def _grams(dimensions: int, seed: int) -> Grams:
    """One table of vectors per worker process."""
    if (dimensions, seed) not in _GRAMS:
        _GRAMS[dimensions, seed] = Grams(dimensions, seed)
    return _GRAMS[dimensions, seed]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in by_bytes(batches, "body", 4 << 20):
        data, at = flat(batch.column("body"))
        whole = data.tobytes()
        yield batch, [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def learn(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order: Column | None = None,
    rows: int = LEARN_ROWS,
    dimensions: int = DIMENSIONS,
    seed: int = 6,
) -> dict[str, np.ndarray]:
    """Prototype of each language in ``docs``, from at most ``rows`` rows per language.

    The rows of the smallest ``order`` (a column; by default a hash of the text) are taken; rows
    without a language or without a letter teach nothing. Tasks add their texts up per language, Spark
    adds these sums; the driver holds one vector per language.
    """
    check_columns(docs, text_col, lang_col)
    order = F.xxhash64(F.col(f"`{text_col}`")) if order is None else order
    known = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(docs, text_col).alias("body"), order.cast("long").alias("_at")).where("lang is not null")
    names = [r["lang"] for r in known.select("lang").distinct().collect()]  # the languages
    if not names:
        return {}
    last, _ = smallest(known, "lang", "_at", dict.fromkeys(names, rows))
    ends = settle(docs.sparkSession.createDataFrame(list(last.items()), "lang string, _last long"), "language-ends")  # small enough to be sent to the scan
    sample = known.join(ends, "lang").where(F.col("_at") <= F.col("_last"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = _grams(dimensions, seed), {}
        for batch, texts in _texts(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                vector = grams.bundle(text)
                if vector is not None:
                    total[lang] = total.get(lang, 0) + vector.astype(np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()])], names=["lang", "v"])

    parts = sample.select("lang", "body").mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():  # languages x dimensions rows
        found.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return {lang: v / max(np.linalg.norm(v), 1e-9) for lang, v in sorted(found.items())}


def lettered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row of ``docs`` whose text has a letter, the rows that ``identify`` can compare."""
    check_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            with_letter = pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(with_letter)], names=["id"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    return rows.mapInArrow(run, "id long").withColumnRenamed("id", id_col)


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", seed: int = 6
) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (cosine with the prototype, 0 to 1).

    Null texts, empty texts and texts without a letter get "und" and score 0, as does every text when
    nothing was learned. Equal cosines go to the first language by name. Whole texts are read, of any
    length. Repeated rows get equal results; an empty table gives an empty table.
    """
    check_columns(docs, id_col, text_col)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32)
    dimensions = matrix.shape[1] if names else DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams(dimensions, seed)
        for batch, texts in _texts(batches):
            langs, scores = [], []
            for text in texts:
                vector = grams.bundle(text) if names else None
                cosines = matrix @ vector if vector is not None else [0.0]
                best = int(np.argmax(cosines))
                langs.append(UNKNOWN if vector is None else names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)

"""Token counts: batches encoded inside Arrow functions, of which only the lengths come back."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns, flat, text_of

BATCH_BYTES = 1 << 20
KNOWN_PIECES = 1_500_000  # pieces whose count a worker remembers, about 150 bytes each
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=\s)")
_LOADED: dict = {}
_PIECES: dict = {}


def _tokenizer(file: str):
    """One tokenizer per worker process."""
    if file not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if file.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(file)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[file] = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        elif file.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=file)
            _LOADED[file] = lambda texts: [len(e) for e in piece.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {file}")
    return _LOADED[file]


class _Lengths:
    """Token counts of pieces between ASCII white space, each distinct piece encoded once.

    No word, special string or composed character reaches over white space, so the counts of the
    pieces add up to the count of the whole text. Encoding goes in batches of about BATCH_BYTES.
    """

    def __init__(self, count):
        self.count, self.known = count, {}

    @staticmethod
    def _pieces(text: bytes) -> list[bytes]:
        """Pieces in ASCII lower case, as the vocabulary has none else, unless a special string may be there.

        A single stop or comma between an ASCII letter and white space is a word of its own.
        """
        return text.split() if b"<|" in text else _STOP.sub(rb" \1", text.lower()).split()

    def learn(self, pieces: set[bytes]) -> None:
        batch, size = [], 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece)
            if size > BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, batch: list[bytes]) -> None:
        if batch:
            self.known.update(zip(batch, self.count([p.decode("utf-8", "replace") for p in batch]), strict=True))

    def of(self, texts: list[bytes]) -> list[int]:
        split = [self._pieces(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new and len(self.known) + len(new) > KNOWN_PIECES:
            self.known, new = {}, set().union(*split)
        self.learn(new)
        get = self.known.__getitem__
        return [sum(map(get, pieces)) for pieces in split]


def _counter(file: str, split: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokenizer(file)
        lengths = _PIECES.setdefault(file, _Lengths(count))
        for batch in by_bytes(batches, "body", BATCH_BYTES):
            data, at = flat(batch.column("body"))
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = lengths.of(texts) if split else count([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, drops_space: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``file`` is the path of a vocabulary on every machine: .json is read by tokenizers, .model by
    sentencepiece. No begin, end or added special tokens; special strings inside texts as is the
    library's default; nothing is cut off. Null and empty texts have 0 bytes and 0 tokens. With
    ``drops_space``, for lower-casing vocabularies whose words never reach over white space, texts of any
    length are split there and each distinct piece of a worker is encoded once; else each text is encoded
    whole. Repeated rows are counted each; an empty table gives an empty table.
    """
    check_columns(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    counted = rows.mapInArrow(_counter(file, drops_space), "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

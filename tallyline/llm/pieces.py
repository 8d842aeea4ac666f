"""Operator 10: encode texts into pieces of a sentencepiece vocabulary, and decode them.

An Aho-Corasick automaton over the pieces reads a text once.  At each position the output links give
every piece that ends there, and each relaxes the best score of the position: the path with the
greatest sum of piece scores (Viterbi).  A character that no piece covers becomes its UTF-8 bytes.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .chunks import Remembered
from .common import small_batches, without
from .token_counts import SPACE, Cutter, read_pieces

UNKNOWN_PENALTY = 10.0  # below the least score of a piece


class PieceAutomaton:
    """goto, fail and output links over the pieces of ``vocabulary``."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.vocabulary = vocabulary
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(vocabulary) if kind == 1]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, (_, _, kind) in enumerate(vocabulary) if kind == 2), 0)
        self.unknown_score = min(s for _, s, _ in normal) - UNKNOWN_PENALTY
        step: list[dict[str, int]] = [{}]
        own: list[tuple[int, float, int] | None] = [None]
        for p, s, i in normal:
            node = 0
            for c in p:
                if c not in step[node]:
                    step[node][c] = len(step)
                    step.append({})
                    own.append(None)
                node = step[node][c]
            own[node] = (len(p), s, i)
        fail, output = [0] * len(step), [0] * len(step)
        todo = deque(step[0].values())
        while todo:
            node = todo.popleft()
            for c, child in step[node].items():
                back = fail[node]
                while back and c not in step[back]:
                    back = fail[back]
                fail[child] = step[back].get(c, 0)
                output[child] = fail[child] if own[fail[child]] else output[fail[child]]
                todo.append(child)
        self.step, self.own, self.fail, self.output = step, own, fail, output
        self.cutter = Cutter([p for p, _, _ in normal])
        self.memory = Remembered(lambda chunks: [np.array(self.best(c), dtype="<i4").tobytes() for c in chunks])

    def best(self, chunk: str) -> list[int]:
        """Ids of the best path; of equal scores the one whose last piece is longest."""
        step, own, fail, output = self.step, self.own, self.fail, self.output
        score = [0.0] + [float("-inf")] * len(chunk)
        came: list[tuple[int, int]] = [(0, -1)] * (len(chunk) + 1)
        node = 0
        for end, c in enumerate(chunk, 1):
            while node and c not in step[node]:
                node = fail[node]
            node = step[node].get(c, 0)
            at, single = node if own[node] else output[node], False
            while at:
                length, s, i = own[at]
                single |= length == 1
                if score[end - length] + s > score[end]:
                    score[end], came[end] = score[end - length] + s, (length, i)
                at = output[at]
            if not single and score[end - 1] + self.unknown_score > score[end]:
                score[end], came[end] = score[end - 1] + self.unknown_score, (1, -1)
        ids: list[int] = []
        end = len(chunk)
        while end:
            length, i = came[end]
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in reversed(chunk[end - 1].encode("utf-8")))
            else:
                ids.append(self.unknown)
            end -= length
        return ids[::-1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        for at, chunks in self.cutter.parts(texts):
            for i, v in enumerate(self.memory.values(chunks), at):
                out[i] += b"".join(v)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: byte pieces joined as UTF-8, the space put before the text removed."""
        parts = [bytes([self.byte_of[i]]) if i in self.byte_of else self.vocabulary[i][0].encode("utf-8") for i in ids]
        text = b"".join(parts).decode("utf-8", errors="replace")
        return text.removeprefix(SPACE).replace(SPACE, " ")


_AUTOMATA: dict[str, PieceAutomaton] = {}


def automaton(model: str) -> PieceAutomaton:
    """One per Python worker and file."""
    if model not in _AUTOMATA:
        _AUTOMATA[model] = PieceAutomaton(read_pieces(model))
    return _AUTOMATA[model]


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of the whole text (a null or empty text: none).  Row by row, without a shuffle."""
    small_batches(docs.sparkSession)

    @pandas_udf("array<int>")
    def encode(texts):
        import pandas as pd
        return pd.Series([np.frombuffer(b, dtype="<i4") for b in automaton(model).encode(texts.tolist())])

    return without(docs, out_col).withColumn(out_col, encode(F.coalesce(F.col(text_col), F.lit(""))))


def decode_pieces(docs: DataFrame, model: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids (null ids: empty).  Ids that no encoder gave are read piece by piece,
    broken UTF-8 as replacement characters."""
    small_batches(docs.sparkSession)

    @pandas_udf("string")
    def decode(ids):
        import pandas as pd
        return pd.Series([automaton(model).decode([] if i is None else i.tolist()) for i in ids], dtype="object")

    return without(docs, out_col).withColumn(out_col, decode(F.col(ids_col)))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, CRC32 of the ids joined by commas, and whether the ids give the text back
    (with the character that stands for a space read as a space)."""
    from .queries import documents, tokenizer
    model = tokenizer("piece_bpe_32k.model")
    encoded = decode_pieces(encode_pieces(documents(spark, sf_dir), model), model)
    text = F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
                          F.crc32(F.array_join("piece_ids", ",").cast("binary")).alias("ids_crc32"),
                          (F.col("decoded") == text).alias("round_trip"))

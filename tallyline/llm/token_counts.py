"""Operator 2: token counts of a byte-fallback piece vocabulary by rank-synchronous array merging.

Distinct chunks of a batch lie in one flat array of symbols.  In each step every chunk applies its
lowest-ranked pair, all chunks at once; chunks without a pair leave the array, and the symbols that
survive are its tokens.  Chunks are cut where no piece of the vocabulary can cross.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .chunks import LONG_TEXT, Remembered, stretches
from .common import small_batches, without

SPACE = "▁"  # how the vocabulary writes a space
LONG = 48  # symbols above which one chunk is merged by a heap instead of taking as many array steps


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of every id, as the sentencepiece library reads the file; type 1 is an ordinary piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [2 if model.is_unknown(i) else 3 if model.is_control(i) else 6 if model.is_byte(i) else 5 if model.is_unused(i) else 1
             for i in range(model.get_piece_size())]
    return [(model.id_to_piece(i), model.get_score(i), k) for i, k in enumerate(kinds)]


class Cutter:
    """Cuts a text (spaces as ``SPACE``, one put before it) where no piece crosses; learnt from the pieces."""

    def __init__(self, pieces: list[str]):
        inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(b[0] != SPACE and b[1] == SPACE for b in inside) or any("\n" in p or "\0" in p for p in pieces):
            raise ValueError("a piece holds a space after another character, or a line end")
        latin = [chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if chr(c).isalnum()]
        letters = "".join(c for c in latin if c + "." not in inside and c + "," not in inside)
        self.unsafe = re.compile(rf"[.,](?<=[^{letters}].)")
        self.gap = re.compile(rf"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)")

    def parts(self, texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
        """(first text, chunks of some texts) for a few texts at a time; a long text comes in several steps by itself."""
        few: list[list[str]] = []
        for i, text in enumerate(texts):
            text = SPACE + text.replace(" ", SPACE) if text else ""
            if len(text) > LONG_TEXT:
                if few:
                    yield i - len(few), few
                    few = []
                for part in stretches(text, self.gap):
                    yield i, [self.cut(part)]
            else:
                few.append(self.cut(text))
                if len(few) == 64:
                    yield i - 63, few
                    few = []
        if few:
            yield len(texts) - len(few), few

    def cut(self, text: str) -> list[str]:
        """Chunks of a text in the vocabulary's writing."""
        if "\0" in text or SPACE + SPACE in text or self.unsafe.search(text):
            return [c for c in self.gap.split(text) if c]
        return [c for c in text.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.").split("\0") if c]


class RankMerger:
    """Counts the pieces of chunks under merges ranked by the score of the piece they make."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        normal = {p: s for p, s, kind in vocabulary if kind == 1}
        self.id = {p: i for i, p in enumerate(sorted(normal))}
        for c in sorted({c for p in normal for c in p}):
            self.id.setdefault(c, len(self.id))
        self.normal = set(normal)
        order = {s: r for r, s in enumerate(sorted(set(normal.values()), reverse=True))}
        size = self.size = len(self.id) + 1  # the last id: a character that no piece holds
        pairs = {}
        for p, s in normal.items():
            for i in range(1, len(p)):
                a, b = self.id.get(p[:i]), self.id.get(p[i:])
                if a is not None and b is not None:
                    pairs[a * size + b] = (order[s], self.id[p])
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = keys
        self.rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        self.cutter = Cutter(list(normal))
        self.memory = Remembered(self.counts)

    def _weight(self, c: str) -> int:
        """Tokens of a character that stays alone: one piece, or its UTF-8 bytes."""
        return 1 if c in self.normal else len(c.encode("utf-8"))

    def counts(self, chunks: list[str]) -> list[int]:
        out = np.zeros(len(chunks), dtype=np.int64)
        short = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                out[i] = self._heap(c)
        if short:
            out[short] = self._arrays([chunks[i] for i in short])
        return out.tolist()

    def _arrays(self, chunks: list[str]) -> np.ndarray:
        text = "".join(chunks)
        unknown = self.size - 1
        symbol = np.fromiter((self.id.get(c, unknown) for c in text), dtype=np.int64, count=len(text))
        weight = np.ones(len(text), dtype=np.int64)
        for c in set(text):
            if c not in self.normal:
                weight[np.fromiter((x == c for x in text), dtype=bool, count=len(text))] = self._weight(c)
        chunk = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        total = np.zeros(len(chunks), dtype=np.int64)
        none = len(self.keys) + 1
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (chunk[:-1] == chunk[1:])
            rank = np.where(hit, self.rank[at], none)
            # Lowest rank of each chunk, the leftmost where it occurs twice.
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            place = np.concatenate([rank, [none]]) * len(symbol) + np.arange(len(symbol))
            best = np.minimum.reduceat(place, first)
            live = best < none * len(symbol)
            left = best[live] % len(symbol)
            done = np.repeat(~live, np.diff(np.concatenate([first, [len(symbol)]])))
            total += np.bincount(chunk[done], weights=weight[done], minlength=len(chunks)).astype(np.int64)
            symbol[left] = self.made[at[left]]
            weight[left] = 1
            keep = ~done
            keep[left + 1] = False
            symbol, weight, chunk = symbol[keep], weight[keep], chunk[keep]
        return total

    def _heap(self, chunk: str) -> int:
        """The same merges for one long chunk, in n log n."""
        n, unknown = len(chunk), self.size - 1
        symbol = [self.id.get(c, unknown) for c in chunk]
        weight = [self._weight(c) for c in chunk]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                found = self.pairs.get(symbol[i] * self.size + symbol[after[i]])
                if found:
                    heapq.heappush(heap, (found[0], i, symbol[i], symbol[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue
            symbol[i], weight[i] = self.pairs[a * self.size + b][1], 1
            symbol[j], weight[j] = -1, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return sum(weight)

    def text_counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for at, chunks in self.cutter.parts(texts):
            for i, v in enumerate(self.memory.values(chunks), at):
                out[i] += sum(v)
        return out


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One per Python worker and file."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(read_pieces(path))
    return _MERGERS[path]


def token_counts(docs: DataFrame, model: str, most_tokens: int, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of the whole text; a null text is empty.

    One pass without a shuffle; every row is counted by itself, so repeated rows, null ids and
    further columns pass through.  Input columns of those three names are replaced.
    """
    small_batches(docs.sparkSession)

    @pandas_udf("long")
    def count(texts):
        import pandas as pd
        return pd.Series(merger(model).text_counts(texts.tolist()), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (without(docs, "n_bytes", "n_tokens", "over_limit")
            .withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", count(text))
            .withColumn("over_limit", F.col("n_tokens") > most_tokens))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents, tokenizer
    counted = token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), most_tokens=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")

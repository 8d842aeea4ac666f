"""Operator 9: remove repeated word passages by suffix automata of reference shards.

A window is ``window`` consecutive words.  Its anchor is the run of ``anchor`` words in it whose hash
is least, the leftmost of equal ones; windows with the same words have the same anchor.  Windows of
one document that share an anchor occurrence form a segment.  The corpus is sharded by anchor: all
occurrences of a window meet in the shard of its anchor, so a shard needs no other shard's text.

1. Segments are counted by (anchor, hash of the segment).  An anchor that occurs once ends here, and
   a segment that occurs twice has only repeated windows.
2. For an anchor with several different segments, a suffix automaton of its segments is built, and
   each segment that occurs once is streamed through it: where the matching statistic reaches the
   window length at a state that occurs twice, the window is repeated.
3. An anchor with more than ``most_segments`` different segments (a passage that a third of all
   documents share, each in other surroundings) is split further, by the words of its windows.

A broadcast of all reference shards would grow with the corpus and send every document through every
shard; here both sides of a shard are routed to one another instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_names, shuffle_partitions, small_batches, spread, stored, text_keys, without

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of a text's words and of its runs of words."""

    def __init__(self, text: str | None):
        import xxhash
        self.words = (text or "").encode("utf-8").split()  # cuts at exactly the six ASCII white-space characters
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter(map(digest, self.words), dtype=np.uint64, count=len(self.words))
        n = len(self.words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(BASE, n), dtype=np.uint64)])
        self.inverse = _powers(UNBASE, n + 1)

    def runs(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Polynomial hashes of the runs, modulo 2^64, mixed."""
        return _mixed((self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts])

    def segments(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, segment hash, first window, number of windows) of each segment."""
        n = len(self.words) - window + 1
        if n <= 0:
            return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        grams = self.runs(np.arange(len(self.words) - anchor + 1), anchor)
        span = window - anchor + 1
        place = np.empty(n, dtype=np.int64)
        for at in range(0, n, 1 << 16):
            view = np.lib.stride_tricks.sliding_window_view(grams[at:min(n, at + (1 << 16)) + span - 1], span)
            place[at:at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        number = np.diff(np.concatenate([first, [n]]))
        # The offset of the anchor belongs to the name of the segment.
        whole = self.runs(first, number + window - 1) ^ _mixed(((place[first] - first).astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        return grams[place[first]], whole, first, number


class SuffixAutomaton:
    """All substrings of the added sequences, with how often each occurs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, following: dict[int, int], link: int, length: int, count: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(count)
        return len(self.next) - 1

    def add(self, sequence: list[int], times: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            known = nxt[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                self.count[known] += times
                last = known
                continue
            if known is not None:
                last = self._split(last, c, known)
                self.count[last] += times
                continue
            cur = self._state({}, 0, length[last] + 1, times)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, 0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def settle(self) -> None:
        """Turn counts of ends into counts of occurrences."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], window: int) -> int:
        """Bit i is set if the window at i occurs twice or more."""
        state, matched, bits = 0, 0, 0
        for at, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(c, 0)
            matched = matched + 1 if state else 0
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] > 1:
                bits |= 1 << (at - window + 1)
        return bits


def _segment_rows(window: int, anchor: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, parts, sizes = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), [], []
            for text in batch.column("text").to_pylist():
                parts.append(Words(text).segments(window, anchor))
                sizes.append(len(parts[-1][0]))
            if not sum(sizes):
                continue
            m, s, first, number = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(one, sizes)), pa.array(np.repeat(two, sizes)), pa.array(m.view(np.int64)), pa.array(s.view(np.int64)),
                 pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))], ["k1", "k2", "m", "s", "first", "number"])
    return rows


def _asked_rows(window: int, anchor: int):
    """Of each asked segment its words' hashes, or for a split anchor its windows' hashes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bool, bytes]] = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                words = Words(text)
                m, s, first, number = words.segments(window, anchor)
                at = {k: i for i, k in enumerate(zip(m.view(np.int64).tolist(), s.view(np.int64).tolist()))}
                for a in asked:
                    i = at.get((a["m"], a["s"]))
                    if i is None:  # another text with the same first key
                        continue
                    if a["split"]:
                        data = words.runs(np.arange(first[i], first[i] + number[i]), window)
                    else:
                        data = words.hashes[first[i]:first[i] + number[i] + window - 1]
                    out.append((a["m"], a["s"], a["n"], a["split"], data.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                                                 ["m", "s", "n", "split", "data"])
    return rows


def _automata(window: int):
    """Rows sorted by anchor in; (m, s, bits) of the segments that occur once out."""
    def settle(m: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        reference = SuffixAutomaton()
        sequences = [np.frombuffer(d, dtype=np.int64).tolist() for _, _, d in rows]
        for (_, n, _), sequence in zip(rows, sequences):
            reference.add(sequence, n)
        reference.settle()
        for (s, n, _), sequence in zip(rows, sequences):
            if n == 1:
                bits = reference.repeated(sequence, window)
                if bits:
                    yield m, s, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for m, s, n, data in zip(*[batch.column(c).to_pylist() for c in ("m", "s", "n", "data")]):
                if m != now and rows:
                    out.extend(settle(now, rows))
                    rows = []
                now = m
                rows.append((s, n, data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], ["m", "s", "bits"])
        if rows and (out := list(settle(now, rows))):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], ["m", "s", "bits"])
    return run


def _split_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.frombuffer(d, dtype=np.int64) for d in batch.column("data").to_pylist()]
        sizes = [len(d) for d in data]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("m", "s", "n")],
                 pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])), pa.array(np.concatenate(data))], ["m", "s", "n", "at", "w"])


def repeated_windows(docs: DataFrame, window: int, anchor: int = 8, most_segments: int = 64) -> DataFrame:
    """k1, k2 (content of a text), spans: array of (first word, bits of repeated windows from there) of texts that have some.

    ``docs`` has k1, k2, text.  ``window - anchor`` must stay below 63, the bits of a long.
    """
    if not 0 < anchor <= window or window - anchor > 62:
        raise ValueError("the anchor must be shorter than the window by at most 62 words")
    spark = docs.sparkSession
    segments = stored(docs.mapInArrow(_segment_rows(window, anchor), "k1 long, k2 long, m long, s long, first int, number int"))
    kinds = segments.groupBy("m", "s").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("k1"), F.max("number").alias("number"))
    kinds = stored(kinds)
    anchors = kinds.groupBy("m").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
                                     F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).filter("total > 1")
    several = anchors.filter("kinds > 1 and once > 0").select("m", (F.col("kinds") > most_segments).alias("split"))
    asked = stored(kinds.join(spread(several), "m").groupBy("k1").agg(F.collect_list(F.struct("m", "s", "n", "split")).alias("asked")))
    texts = docs.select("k1", "k2", "text").join(asked, "k1").select("text", "asked")
    sent = stored(texts.mapInArrow(_asked_rows(window, anchor), "m long, s long, n long, split boolean, data binary").dropDuplicates(["m", "s"]))
    own = sent.filter("not split").repartition(shuffle_partitions(spark), "m").sortWithinPartitions("m")
    by_shard = own.mapInArrow(_automata(window), "m long, s long, bits long")
    windows = sent.filter("split").mapInArrow(_split_windows, "m long, s long, n long, at int, w long")
    found = windows.groupBy("m", "w").agg(F.sum("n").alias("times")).filter("times > 1").drop("times")
    by_window = (windows.filter("n = 1").join(spread(found), ["m", "w"]).groupBy("m", "s")
                 .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")))
    twice = kinds.filter("n > 1").select("m", "s", (F.expr("shiftleft(1L, number)") - 1).alias("bits"))
    bits = twice.unionByName(by_shard).unionByName(by_window)
    return stored(segments.join(spread(bits), ["m", "s"]).groupBy("k1", "k2")
                  .agg(F.collect_set(F.struct("first", "bits")).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_removed, removed_spans (array of [first word, end word)) and kept_text (kept words
    joined by one space): each word under a window that also starts anywhere else goes, in every copy.

    Windows are judged on the input.  A null or empty text has no words; texts shorter than the window
    lose nothing; repeated rows are copies of each other, whatever their ids.
    """
    small_batches(docs.sparkSession)
    clean = without(docs, "n_words", "n_removed", "removed_spans", "kept_text")
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two = text_keys(text)
    # Helper columns take names that the caller's columns leave free.
    first, second, found, result = free_names(clean, "_k1", "_k2", "spans", "_cut")
    keyed = clean.withColumns({first: one, second: two})
    spans = repeated_windows(docs.select(one.alias("k1"), two.alias("k2"), text.alias("text")), window, **options)
    joined = keyed.join(spans.select(F.col("k1").alias(first), F.col("k2").alias(second), F.col("spans").alias(found)), [first, second], "left")
    schema = "n_words long, n_removed long, removed_spans array<array<int>>, kept_text string"

    @F.pandas_udf(schema)
    def cut(texts, found):
        import pandas as pd
        rows = []
        for t, spans in zip(texts, found):
            words = t.encode("utf-8").split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for span in spans if spans is not None else ():
                for i in range(int(span["bits"]).bit_length()):
                    if span["bits"] >> i & 1:
                        gone[span["first"] + i] += 1
                        gone[span["first"] + i + window] -= 1
            lost = np.cumsum(gone[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8))).reshape(-1, 2)
            kept = b" ".join(w for w, g in zip(words, lost.tolist()) if not g).decode("utf-8")
            rows.append((len(words), int(lost.sum()), edges.tolist(), kept))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "removed_spans", "kept_text"])

    done = joined.withColumn(result, cut(text, F.col(found)))
    return done.select(*clean.columns, f"{result}.*")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

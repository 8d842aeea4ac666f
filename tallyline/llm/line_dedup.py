"""Operator 4: remove blocks of lines that an earlier document already holds.

Documents meet through hashes of their lines: a line that several documents hold links each later
one to the first that holds it, so a line in a third of all documents gives one link per document,
not one per pair.  Each linked pair is aligned by patience diff: lines that are unique in both
documents are anchors, the longest increasing chain of them is kept, and the stretches between and
beside them are aligned in the same way.  Aligned blocks go from the later document.

A block that an earlier document holds whole need not be aligned with any first holder of its lines.
Neighbouring lines are therefore looked up as well: each two that stand side by side in an earlier
document belong to a run, runs that share a line are one, and a run goes like a block.  So every block
of two lines or more goes, whichever document held it.  What goes is always held by the first document
with that line, which keeps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LAST, free_names, small_batches, spread, stored, text_keys, without


def full_lines(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines with a word; blank lines take no part in blocks."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if line.strip(" \t\n\r\x0b\x0c")]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and distinct line, and per distinct two neighbouring full lines (``pair``): the two hashes and
    the places, of the first line for a pair, among the document's full lines."""
    import xxhash
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("ord", "k1", "k2")]
        out: list[tuple] = []
        for o, one, two, text in zip(*keys, batch.column("text").to_pylist()):
            at: dict[str, list[int]] = {}
            lines = [line for _, line in full_lines(text)]
            for place, line in enumerate(lines):
                at.setdefault(line, []).append(place)
            single = len(at)
            for place, pair in enumerate(zip(lines, lines[1:])):
                at.setdefault("\n".join(pair), []).append(place)
            for number, (line, places) in enumerate(at.items()):
                data = line.encode("utf-8")
                out.append((o, one, two, xxhash.xxh3_64_intdigest(data) - 2**63, xxhash.xxh64_intdigest(data) - 2**63, number >= single, places))
        if out:
            types = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], ["ord", "k1", "k2", "h1", "h2", "pair", "places"])


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain with both places ascending, of pairs sorted by the first."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(ends, b)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(b)
            last.append(i)
        else:
            ends[k], last[k] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(here: dict[int, int], there: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned places of two documents given as place -> line number, lines of neither partner left out."""
    out: list[tuple[int, int]] = []
    todo = [(sorted(here), sorted(there))]
    while todo:
        a, b = todo.pop()
        # Equal heads and tails that touch the border of the stretch.
        while a and b and here[a[0]] == there[b[0]]:
            out.append((a[0], b[0]))
            a, b = a[1:], b[1:]
        while a and b and here[a[-1]] == there[b[-1]]:
            out.append((a[-1], b[-1]))
            a, b = a[:-1], b[:-1]
        if not a or not b:
            continue
        one, two = {}, {}
        for places, lines, found in ((a, here, one), (b, there, two)):
            for p in places:
                found.setdefault(lines[p], []).append(p)
        anchors = _chain(sorted((p[0], two[line][0]) for line, p in one.items() if len(p) == 1 and len(two.get(line, ())) == 1))
        i = j = 0
        for p, q in anchors:
            x, y = bisect_left(a, p), bisect_left(b, q)
            todo.append((a[i:x], b[j:y]))
            out.append((p, q))
            i, j = x + 1, y + 1
        if anchors:
            todo.append((a[i:], b[j:]))
    return sorted(out)


def blocks(aligned: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of aligned places that follow each other in both documents."""
    out: list[list[int]] = []
    before = None
    for p, q in aligned:
        if before == (p - 1, q - 1):
            out[-1].append(p)
        else:
            out.append([p])
        before = (p, q)
    return out


def runs(starts: set[int]) -> list[list[int]]:
    """Runs of places made of the pairs (start, start + 1), joined where they share a place."""
    out: list[list[int]] = []
    for p in sorted(starts):
        if p - 1 in starts:
            out[-1].append(p + 1)
        else:
            out.append([p, p + 1])
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """ord, k1, k2 of a document and ``blocks``: its runs of lines that earlier documents hold side by side, and its aligned
    blocks with the first holders of its lines, as arrays of places among its full lines; a place may stand in
    several.  ``docs`` has ord, k1, k2, text."""
    lines = stored(docs.mapInArrow(_line_rows, "ord long, k1 long, k2 long, h1 long, h2 long, pair boolean, places array<int>"))
    # Of a pair only its presence in an earlier document counts.
    held = F.when(~F.col("pair"), F.col("places")).alias("places")
    first = (lines.groupBy("h1", "h2").agg(F.min(F.struct("ord", "k1", "k2", held)).alias("first"), F.max("ord").alias("last"))
             .filter("last > first.ord").drop("last"))
    linked = lines.join(spread(first), ["h1", "h2"]).filter("ord > first.ord")
    # One row per document: all its linked lines and pairs, at most twice as many as it has lines.
    gathered = linked.groupBy("ord", "k1", "k2").agg(F.collect_list(F.struct("pair", "places", "first")).alias("links"))

    @F.pandas_udf("array<array<int>>")
    def align(links):
        import pandas as pd
        out = []
        for doc in links:
            pairs: dict[tuple[int, int, int], tuple[dict[int, int], dict[int, int]]] = {}
            starts: set[int] = set()
            for n, link in enumerate(doc):
                if link["pair"]:
                    starts.update(int(p) for p in link["places"])
                    continue
                first = link["first"]
                here, there = pairs.setdefault((first["ord"], first["k1"], first["k2"]), ({}, {}))
                here.update((int(p), n) for p in link["places"])
                there.update((int(p), n) for p in first["places"])
            out.append([*runs(starts), *[b for key in sorted(pairs) for b in blocks(patience(*pairs[key]))]])
        return pd.Series(out)

    return stored(gathered.select("ord", "k1", "k2", align("links").alias("blocks")))


def remove_lines(docs: DataFrame, least_chars: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_deleted (full lines) and kept_text: aligned blocks and runs of at least ``least_chars``
    characters go from the later document, with the blank lines inside a block.

    Earlier means a smaller id; a document without id comes after all others.  Rows with one id are one
    document and never earlier than each other: repeated rows get the same result.  A null or empty text
    has no line; kept_text of a text that loses nothing is the text itself.
    """
    small_batches(docs.sparkSession)
    clean = without(docs, "n_lines", "n_deleted", "kept_text")
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two = text_keys(text)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    found = repeated_lines(docs.select(order.alias("ord"), one.alias("k1"), two.alias("k2"), text.alias("text")))
    # Helper columns take names that the caller's columns leave free.
    at, first, second, places, result = free_names(clean, "_ord", "_k1", "_k2", "blocks", "_cut")
    found = found.select(F.col("ord").alias(at), F.col("k1").alias(first), F.col("k2").alias(second), F.col("blocks").alias(places))
    joined = clean.withColumns({at: order, first: one, second: two}).join(found, [at, first, second], "left")

    @F.pandas_udf("n_lines long, n_deleted long, kept_text string")
    def cut(texts, blocks):
        import pandas as pd
        rows = []
        for t, found in zip(texts, blocks):
            full = full_lines(t)
            gone: set[int] = set()
            deleted: set[int] = set()
            for block in found if found is not None else ():
                block = [int(p) for p in block]
                if sum(len(full[p][1]) for p in block) >= least_chars:
                    deleted.update(block)
                    gone.update(range(full[block[0]][0], full[block[-1]][0] + 1))
            rows.append((len(full), len(deleted), "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone) if gone else t))
        return pd.DataFrame(rows, columns=["n_lines", "n_deleted", "kept_text"])

    done = joined.withColumn(result, cut(text, F.col(places)))
    return done.select(*clean.columns, f"{result}.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    cut = remove_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_deleted", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

"""Operator 12: personal data by fixed patterns and by bootstrapped contexts.

Fixed patterns give the base spans, which always stay.  Their values are the seeds: the words around them
become lexical patterns, patterns and values form a graph over the corpus, and each round scores patterns
by the values they hold and values by the patterns they stand in.  Where a high-scoring pattern surrounds a
high-scoring value that no fixed pattern matched, the span is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import spread, stored, text_keys, without

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What may be personal data although no fixed pattern matches: a written-out address (from its at sign on), hexadecimal
# groups, and numbers in groups.
_WRITTEN = re.compile(r"(?:@|[aA][tT](?![A-Za-z])) ?[\])}>]? ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<]? ?\b(?:dot|DOT)\b ?[\])}>]? ?)[A-Za-z0-9-]{1,63})+")
_GROUPS = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])")
_NUMBERS = re.compile(r"[0-9]+(?:[ ./()-]{1,2}[0-9]+)*")
_WORD = re.compile(r"[^ \t-\r]+")
SPAN = T.StructType([T.StructField(name, T.IntegerType()) for name in ("kind", "start", "end")])
MENTION = T.StructType([T.StructField(name, T.IntegerType()) for name in ("kind", "fits", "start", "end")]
                       + [T.StructField("value", T.StringType()), T.StructField("contexts", T.ArrayType(T.StringType()))])


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the at sign to both sides, so that
    long texts without one cost nothing."""
    free = 0
    for found in _DOMAIN.finditer(text) if "@" in text else ():
        start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            free = found.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers of at most 255: longer chains give each four in turn, as a search from the left does."""
    for chain in _DOTTED.finditer(text) if "." in text else ():
        if chain.group().count(".") < 3:
            continue
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            if all(len(v) < 4 and int(v or 0) < 256 for v in (p.group().lstrip("0") for p in four)):
                yield four[0].start(), four[3].end()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _DIGITS.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(ch.isdigit() for ch in found.group()) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind; code points, end exclusive."""
    found = [(k, s, e) for k, rule in enumerate((emails, addresses, cards, phones)) for s, e in rule(text)]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def _written(text: str) -> Iterator[tuple[int, int, int]]:
    for found in _WRITTEN.finditer(text):
        at = found.start()
        while at > 0 and found.start() - at < 3 and text[at - 1] in " [({<":
            at -= 1
        start = at
        while start > 0 and at - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (text[found.start()] == "@" or at < found.start()):
            yield 1, start, found.end()


def _grouped(text: str) -> Iterator[tuple[int, int, int]]:
    for found in _GROUPS.finditer(text) if text.count(":") > 1 else ():
        if found.start() == 0 or not (text[found.start() - 1].isalnum() or text[found.start() - 1] == ":"):
            yield 2, *found.span()


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    for found in _NUMBERS.finditer(text):
        digits = sum(ch.isdigit() for ch in found.group())
        fits = (4 if 12 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)
        start, end = found.span()
        if fits and not (start > 0 and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
            yield fits, start - (start > 0 and text[start - 1] == "("), end


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(bits of the kinds it fits, start, end) of what looks like an identifier, leftmost first, without overlaps."""
    out: list[tuple[int, int, int]] = []
    for fits, start, end in sorted([*_written(text), *_grouped(text), *_numbers(text)], key=lambda x: (x[1], -x[2])):
        if not out or start >= out[-1][2]:
            out.append((fits, start, end))
    return out


def normal(value: str) -> str:
    """An identifier without the separators that writers vary."""
    return re.sub(r"[ ()\[\]{}<>-]+", "", value).lower()


def _short(word: str) -> str:
    """A word as it stands in a pattern: lower case, digits alike."""
    return _PART.sub("0", word.lower())


def contexts(before: list[str], after: list[str]) -> list[str]:
    """Patterns of a place: two words before, a word on each side, two words after."""
    b1, b2 = (before[-1] if before else ""), (before[-2] if len(before) > 1 else "")
    a1, a2 = (after[0] if after else ""), (after[1] if len(after) > 1 else "")
    out = []
    if b2:
        out.append(f"{b2} {b1} _")
    if b1 and a1:
        out.append(f"{b1} _ {a1}")
    if a2:
        out.append(f"_ {a1} {a2}")
    return out


class Words:
    """Places of a text's words; a pattern uses the 64 characters of a word that are nearest to the identifier."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [found.span() for found in _WORD.finditer(text)]

    def around(self, start: int, end: int) -> list[str]:
        i = bisect_left(self.spans, (start, 0))  # words that begin before the identifier
        before = [_short(self.text[max(s, min(e, start) - 64):min(e, start)]) for s, e in self.spans[max(0, i - 2):i]]
        j = bisect_right(self.spans, (end, 0))
        if j and self.spans[j - 1][1] > end:
            j -= 1  # the identifier ends inside this word
        after = [_short(self.text[max(s, end):min(e, max(s, end) + 64)]) for s, e in self.spans[j:j + 2]]
        return contexts(before, after)


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans of a text, and its mentions: base spans and other likely identifiers, with their patterns."""
    spans = base_spans(text)
    loose = loose_spans(text)
    if not spans and not loose:
        return [], []
    around = Words(text).around
    mentions = [(k, 1 << k, s, e, normal(text[s:e]), around(s, e)) for k, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    at = reach = 0
    for fits, start, end in loose:
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            mentions.append((None, fits, start, end, normal(text[start:end]), around(start, end)))
    return spans, mentions


@F.pandas_udf(T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("mentions", T.ArrayType(MENTION))]))
def scanned(text: pd.Series) -> pd.DataFrame:
    found = [scan(t or "") for t in text]
    return pd.DataFrame({
        "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans, _ in found],
        "mentions": [[{"kind": k, "fits": f, "start": s, "end": e, "value": v, "contexts": c} for k, f, s, e, v, c in m] for _, m in found]})


def _kinds(bits: Column) -> Column:
    """Numbers of the kinds in a set of bits."""
    return F.filter(F.array(*[F.lit(k) for k in range(len(KINDS))]), lambda k: F.get(F.array(*[
        bits.bitwiseAND(1 << i) != 0 for i in range(len(KINDS))]), k))


def pattern_graph(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, values) of mentions (value, kind, fits, contexts).

    edges: pattern, value, once each, so that copies of a text count once; only patterns with several values, since one value
    says nothing about another.  values: value, seeds (bits of the kinds a fixed pattern found it as), fits (bits of possible kinds).
    """
    edges = mentions.select(F.explode("contexts").alias("pattern"), "value").distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seeds = F.when(F.col("kind").isNull(), 0).otherwise(F.element_at(F.array(*[F.lit(1 << k) for k in range(len(KINDS))]), F.col("kind") + 1))
    values = mentions.groupBy("value").agg(F.bit_or(seeds).alias("seeds"), F.bit_or("fits").alias("fits"))
    return edges.join(spread(sizes), "pattern"), values


def score_graph(edges: DataFrame, values: DataFrame, rounds: int = 3, least_support: int = 3, trusted: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(patterns, scores) after some rounds over the graph: pattern, kind, confidence; value, kind, score.

    A seed has score 1 for its own kinds.  A pattern's confidence in a kind is the score its values hold over the number of
    its values and one, where at least ``least_support`` of them are trusted; another value's score is the chance that not
    all its patterns err, for the kinds it fits.  Values trusted in one round support patterns in the next.
    """
    seeds = stored(values.filter("seeds > 0").select("value", F.explode(_kinds(F.col("seeds"))).alias("kind"), F.lit(1.0).alias("score")))
    open_edges = stored(edges.join(values.filter("seeds = 0").select("value", "fits"), "value"))
    scores, patterns = seeds, None
    for _ in range(rounds):
        held = edges.join(spread(scores), "value").groupBy("pattern", "kind").agg(
            F.sum("score").alias("mass"), F.count_if(F.col("score") >= trusted).alias("support"), F.first("n").alias("n"))
        patterns = stored(held.filter(F.col("support") >= least_support).select(
            "pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("confidence")))
        reached = open_edges.join(spread(patterns), "pattern").filter(F.array_contains(_kinds(F.col("fits")), F.col("kind")))
        found = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = stored(seeds.unionByName(found))
    return patterns, scores


def added_spans(mentions: DataFrame, patterns: DataFrame, scores: DataFrame, sure: float = 0.7, trusted: float = 0.8) -> DataFrame:
    """k1, k2, kind, start, end of mentions without a fixed pattern whose value is trusted and which stand in a sure pattern
    of the same kind.  Of several kinds the one with the higher score counts, then the first."""
    good = scores.filter(F.col("score") >= trusted)
    places = mentions.filter("kind is null").select("k1", "k2", "start", "end", "value", F.explode("contexts").alias("pattern")).distinct()
    met = (places.join(spread(patterns.filter(F.col("confidence") >= sure).select("pattern", "kind")), "pattern")
           .join(spread(good), ["value", "kind"]))
    return met.groupBy("k1", "k2", "start", "end").agg(
        F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind")).select("k1", "k2", "kind", "start", "end")


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rounds: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) with base_spans and spans: arrays of (kind number, start, end), by start, then kind.

    Spans are in code points, end exclusive; ``spans`` holds the base spans and those that contexts add.  A null text is empty.
    Whole texts are searched in time that grows with their length.  Spans depend on the text alone, so rows with one text get equal
    ones, and copies of a text weigh in the graph as one.  Columns of ``docs`` named like a result are replaced; an empty table gives none.
    """
    clean = without(docs.select(*(keep if keep is not None else docs.columns)), "base_spans", "spans")
    k1, k2 = text_keys(F.coalesce(text_col, F.lit("")))
    kept = F.struct(*[F.col(f"`{c}`") for c in clean.columns]) if clean.columns else F.struct(F.lit(0))
    rows = stored(docs.select(kept.alias("row"), k1.alias("k1"), k2.alias("k2"), scanned(text_col).alias("s")).select("row", "k1", "k2", "s.*"))
    mentions = stored(rows.filter(F.size("mentions") > 0).select("k1", "k2", F.explode("mentions").alias("m")).select("k1", "k2", "m.*"))
    edges, values = pattern_graph(mentions)
    patterns, scores = score_graph(stored(edges), stored(values), rounds)
    more = added_spans(mentions, patterns, scores).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    both = F.concat("spans", F.coalesce("more", F.array().cast(T.ArrayType(SPAN))))
    by_start = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["start"], x["kind"], x["end"]))),
                                     lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.join(stored(more), ["k1", "k2"], "left").select("row.*", F.col("spans").alias("base_spans"), by_start(both).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


@F.pandas_udf(T.StringType())
def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with each run of overlapping spans replaced by the kind of its first span, in brackets."""
    def one(t: str | None, found) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for span in found:
            if span["start"] >= at:
                out += [t[at:span["start"]], f"[{KINDS[span['kind']]}]"]
            at = max(at, span["end"])
        return "".join(out) + t[at:]

    return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of base spans."""
    from .queries import documents
    found = find_personal_data(documents(spark, sf_dir), keep=["doc_id"])
    of_kind = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base_spans")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"))

"""Exact greedy name grouping (leader and complete-link) at scale.

Greedy grouping is defined by input order.  Leader grouping is evaluated on the graph of similar names,
by rounds of joins in which every name decides as soon as nothing earlier can change its choice; complete link
goes through the names chunk by chunk.  No pass is made per leader or per group.

* Candidates come from an equi join on rare bigrams.  If ratio(a, b) >= t, the names
  share at least (1.5t-1)(la+lb)-1 adjacent pairs of characters, so sorting each
  name's bigrams by one global order, the first ``n - bound + 1`` of each must meet.
  Names too short for that bound use single characters, where the bound is t(la+lb)/2.
  The filter loses no pair.
* A leader is a name without an earlier similar leader.  A big family of alike names depends on a few early
  names one after the other, so a bounded number of earliest names is walked in order; their leaders take
  their families out of the table.  Where the walk finds mostly loners, pairs are few: similar pairs among the earliest
  names of every token become edges, and rounds of joins over them settle all parts of the graph at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.similarity import may_reach, ratios, similarity
from ..session import cut_lineage
from .common import dealt, first_by_pos, number_in_groups

EPS = 1e-9


@dataclass(frozen=True)
class Budget:
    """Sizes that shape a round; none of them changes a result."""
    walked_names: int = 65_536  # names that one walk may look at
    walked_pairs: int = 250_000  # and comparisons it may make before it ends
    per_token: int = 64  # earliest names of a token that a first round of joins settles
    candidate_rows: int = 4_000_000  # meetings that a round may have in any case
    rows_per_token: int = 32  # and as many for each token of a name
    key_pairs: int = 4_000_000  # meetings at one key, beyond which it is split
    part_edges: int = 1 << 27  # pairs of names among those that one task walks for complete link
    group_buckets: int = 64  # tasks that hold the groups of a scope so far
    bucket_names: int = 256  # names of a scope for each of them
    alone_names: int = 1024  # names of a scope that one task compares and walks


def _bigram_floor(threshold: float) -> int:
    """Shortest name for which the bigram bound is positive against every allowed partner."""
    if threshold <= 2 / 3 + 0.02:
        return 1 << 30
    n = 1
    while _bigram_bound(n, threshold) < 1:
        n += 1
    return n


def _bigram_bound(length: float, threshold: float) -> int:
    """Shared bigrams a name of this length needs with its shortest allowed partner."""
    return math.ceil((1.5 * threshold - 1) * length * 2 / (2 - threshold) - 1 - EPS)


def _bags(threshold: float) -> Column:
    """Tokens of ``name``, numbered: the k-th 'ab' is a different token from the first.  Bigrams begin with 2, characters with 1."""
    chars = F.filter(F.split("name", ""), lambda c: c != "")
    length = F.length("name")
    floor = _bigram_floor(threshold)
    # A name near the floor may meet a shorter partner, so it carries both kinds.
    uni_limit = math.floor((floor - 1) * (2 - threshold) / threshold + EPS)
    empty = F.array().cast("array<string>")
    grams = F.when(length >= floor, F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.concat(
        F.lit("2"), F.substr(F.col("name"), i, F.lit(2))))).otherwise(empty)
    singles = F.when((length >= 1) & (length <= uni_limit), F.transform(chars, lambda c: F.concat(F.lit("1"), c))).otherwise(empty)

    def numbered(bag: Column) -> Column:
        return F.transform(bag, lambda g, i: F.concat(g, F.lit("\u0001"), (i + 1 - F.array_position(bag, g)).cast("string")))

    return F.concat(numbered(F.array_sort(grams)), numbered(F.array_sort(singles)))


def with_prefix(names: DataFrame, threshold: float) -> DataFrame:
    """Distinct ``name`` with ``prefix``: its rarest tokens, as many as must include a shared one.

    All tokens are ranked by a table of their frequencies; bigrams come first.
    """
    each = names.select("name", F.explode(_bags(threshold)).alias("token"))
    frequency = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "token")))
    ranked = each.join(dealt(frequency), "token").groupBy("name").agg(order.alias("order"))
    length = F.length("name")
    grams = F.ceil((1.5 * threshold - 1) * length * 2 / (2 - threshold) - 1 - EPS)
    singles = F.ceil(length * threshold / (2 - threshold) - EPS)

    def rarest(kind: str, need: Column) -> Column:
        own = F.filter(F.transform("order", lambda s: s["token"]), lambda t: t.startswith(kind))
        return F.slice(own, F.lit(1), F.greatest(F.size(own) - F.greatest(need, F.lit(1)) + 1, F.lit(0)).cast("int"))

    prefix = ranked.select("name", F.concat(rarest("2", grams), rarest("1", singles)).alias("prefix"))
    return names.join(prefix, "name", "left").withColumn("prefix", F.coalesce("prefix", F.array().cast("array<string>")))


def _near(shown: str, threshold: float) -> Column:
    """Test of a meeting at ``token`` of ``name`` (prefix) and ``other`` (tokens ``shown``): it is their first common token, and
    the names pass the cheap tests of length and edit distance."""
    first = F.element_at(F.array_intersect(shown, "prefix"), 1) == F.col("token")
    # Two names that both carry bigrams are sure to meet there; single characters serve the short ones.
    shorter = F.least(F.length("name"), F.length("other"))
    kind = F.col("token").startswith("2") | (shorter < _bigram_floor(threshold))
    return first & kind & may_reach("name", "other", threshold)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, *, strict: bool = False,
                  scope: str | None = None, half: bool = False, budget: Budget = Budget()) -> DataFrame:
    """Pairs (name, other, ratio) with ratio >= threshold (> when strict), both sides distinct names.

    ``half`` gives each unordered pair of different names once (name < other), for a table met with itself.
    ``scope`` names a column both sides have; pairs must agree on it.  A pair that
    shares several tokens is kept once, at the first of them, without a shuffle.  A key (token, scope) with very many
    meetings is split: the right names are dealt over its parts, the left ones go to each part.
    """
    keys = [scope] if scope else []
    both = left.select("name").unionByName(right.select("name")).distinct()
    prefixes = cut_lineage(with_prefix(both, threshold))
    on = [*keys, "token"]
    l = left.select(*keys, "name").distinct().join(prefixes, "name").select(*keys, "name", "prefix", F.explode("prefix").alias("token"))
    r = (right.select(*keys, "name").distinct().join(prefixes, "name")
         .select(*keys, F.col("name").alias("other"), F.col("prefix").alias("shown"), F.explode("prefix").alias("token")))
    sizes = l.groupBy(*on).agg(F.count(F.lit(1)).alias("nl")).join(r.groupBy(*on).agg(F.count(F.lit(1)).alias("nr")), on)
    parts = F.ceil(F.col("nl") * F.col("nr") / F.lit(budget.key_pairs)).cast("int")
    hot = cut_lineage(sizes.select(*on, F.least(parts, F.col("nr").cast("int")).alias("parts")).filter("parts > 1"))
    l = l.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    r = r.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    met = l.join(r, [*on, "part"])
    if half:
        met = met.filter(F.col("name") < F.col("other"))
    near = met.filter(_near("shown", threshold)).select(*keys, "name", "other")
    scored = near.withColumn("ratio", similarity("name", "other"))
    hit = F.col("ratio") > threshold if strict else F.col("ratio") >= threshold
    return scored.filter(hit)


def _steps(threshold: float) -> Column:
    """Inserted and deleted characters that ``name`` and ``other`` may differ in."""
    return F.floor((F.length("name") + F.length("other")) * (1.0 - threshold) + F.lit(EPS))


def one_step_pairs(left: DataFrame, right: DataFrame, threshold: float, scope: str) -> DataFrame:
    """Pairs (scope, name, other, ratio) of different names with ratio > threshold that are so short that one step is all they may differ in.

    Then one name is the other without one character, and the shorter one's first or second half stands at the same
    end of the longer one: an equi join on halves, which keep far fewer names together than bigrams do.
    """
    def halves(shorter: bool, side: str) -> list[Column]:
        n = F.length("name") if shorter else F.length("name") - 1
        h = F.floor(n / 2).cast("int")
        return [F.struct(F.lit(side).alias("side"), n.alias("n"), F.lit(end).alias("end"), text.alias("half")) for end, text in (
            ("first", F.left("name", h)), ("second", F.right("name", n - h)))]

    keyed = lambda df, own, other: df.select(scope, "name").distinct().select(
        scope, "name", F.explode(F.array(*halves(True, own), *halves(False, other))).alias("k"))
    met = keyed(left, "left", "right").join(keyed(right, "right", "left").withColumnRenamed("name", "other"), [scope, "k"])
    half = F.floor(F.col("k.n") / 2).cast("int")
    once = (F.col("k.end") == "first") | (F.left("name", half) != F.left("other", half))
    near = met.filter(once & (_steps(threshold) == 1) & (F.levenshtein("name", "other", 1) == 1))
    total = F.length("name") + F.length("other")
    return near.select(scope, "name", "other", (F.lit(2.0) * F.least(F.length("name"), F.length("other")) / total).alias("ratio")).filter(
        F.col("ratio") > threshold)


def may_differ_more(name: Column | str, threshold: float) -> Column:
    """Whether a name and a partner of the greatest allowed length may differ in more than one step."""
    return F.length(name) * (2.0 * (1.0 - threshold) / threshold) >= 2.0 - 1e-6


def more_step_pairs(left: DataFrame, right: DataFrame, threshold: float, scope: str) -> DataFrame:
    """The pairs that ``one_step_pairs`` leaves out."""
    long = lambda df: df.filter(may_differ_more("name", threshold))
    return similar_pairs(long(left), long(right), threshold, strict=True, scope=scope).filter(_steps(threshold) > 1).select(
        scope, "name", "other", "ratio")


def long_enough(name: Column | str, threshold: float) -> Column:
    """Whether a name can have a ratio above the threshold with any *different* name.

    Different names are at least one step apart, so ratio > t needs la + lb > 1/(1-t), and the
    length bound allows la + lb <= 2*la/t.  Names that fail need no similarity join.
    """
    return F.length(name) > threshold / (2 * (1 - threshold)) - EPS


# ---- leader grouping

def _earliest_per_token(tokens: DataFrame, budget: Budget) -> int | None:
    """How many names of each token a round settles among themselves; None for all, where their pairs are few enough."""
    steps = [budget.per_token * 8**i for i in range(8)]
    sizes = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    half = lambda n: F.sum(n * (n - 1) / 2)
    row = sizes.agg(F.sum("n").alias("rows"), half(F.col("n")).alias("all"),
                    *[half(F.least("n", F.lit(k))).alias(f"k{i}") for i, k in enumerate(steps)]).first()
    most = max(budget.candidate_rows, budget.rows_per_token * (row["rows"] or 0))
    if (row["all"] or 0) <= most:
        return None
    return max([k for i, k in enumerate(steps) if row[f"k{i}"] <= most], default=steps[0])


def _similar(later: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs (u, v) of two tables of pos, name, prefix and held tokens, u earlier."""
    later = later.select(F.col("pos").alias("v"), "name", "prefix", F.explode("prefix").alias("token"))
    earlier = earlier.select(F.col("pos").alias("u"), F.col("name").alias("other"), F.col("held").alias("shown"), F.explode("held").alias("token"))
    near = later.join(earlier, "token").filter(F.col("u") < F.col("v")).filter(_near("shown", threshold)).select("u", "v", "name", "other")
    return near.filter(similarity("name", "other") >= threshold).select("u", "v")


def _first_edges(open_names: DataFrame, threshold: float, budget: Budget, least: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(edges, partly known names, k): all earlier similar names of each name that is among the earliest k of all its tokens.

    The other names are partly known: None where there are so few pairs that all are compared.
    """
    tokens = open_names.select("pos", F.explode("prefix").alias("token"))
    k = _earliest_per_token(tokens, budget)
    if k is None:
        return cut_lineage(_similar(open_names, open_names.withColumn("held", F.col("prefix")), threshold)), None, 0
    k = max(k, least)
    rank = F.row_number().over(Window.partitionBy("token").orderBy("pos"))
    held = tokens.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("pos").agg(F.collect_list("token").alias("held"))
    early = cut_lineage(open_names.join(held, "pos", "left").withColumn("held", F.array_intersect("prefix", F.coalesce("held", F.array().cast("array<string>")))))
    known = F.size("held") == F.size("prefix")
    return (cut_lineage(_similar(early.filter(known), early.filter(F.size("held") > 0), threshold)),
            cut_lineage(early.filter(~known).select("pos")), k)


def _except(df: DataFrame, column: str, gone: DataFrame | None) -> DataFrame:
    """Rows whose ``column`` is not a ``pos`` of ``gone``."""
    return df if gone is None else df.join(gone.select(F.col("pos").alias(column)), column, "left_anti")


def _settled(edges: DataFrame, partly: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(followers, edges left open) among names whose earlier similar names are all known.

    In each round the names without an undecided earlier neighbour lead and their neighbours follow; both leave the edges.
    """
    left = edges if partly is None else cut_lineage(_except(edges, "v", partly))
    followers: DataFrame | None = None
    while not left.isEmpty():
        waiting = left.select(F.col("v").alias("pos")).distinct()
        led = _except(_except(left, "u", waiting), "u", partly)
        new = cut_lineage(led.select(F.col("v").alias("pos")).distinct())
        if partly is not None and new.isEmpty():
            return followers, left
        followers = new if followers is None else followers.unionByName(new)
        left = cut_lineage(_except(_except(left, "v", new), "u", new))
    return followers, None


def _walked(open_names: DataFrame, threshold: float, budget: Budget) -> tuple[list[tuple[int, str]], int]:
    """((pos, name) of leaders, names walked): greedy grouping of the earliest names in order, as far as the budget goes.

    Blocks of doubling size are compared with the leaders so far, then among themselves, leader by leader.  The leaders that
    come back are no more than a walk of bounded work can find.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("pos")
        names, at = rows["name"].to_numpy(dtype=object), rows["pos"].to_numpy()
        found: list[int] = []
        start, size, spent = 0, 64, 0
        while start < len(names) and spent < budget.walked_pairs:
            rest = np.arange(start, min(start + size, len(names)))
            start, size = start + len(rest), 2 * size
            known = list(found)
            while len(rest):
                head = known.pop(0) if known else int(rest[0])
                spent += len(rest)
                near = ratios(names[rest], np.full(len(rest), names[head], dtype=object)) >= threshold
                if head == rest[0]:
                    found.append(head)
                rest = rest[~near]
        yield pd.DataFrame({"pos": at[found], "name": names[found], "walked": start})

    first = open_names.select("pos", "name").orderBy("pos").limit(budget.walked_names).coalesce(1)
    lead = first.mapInPandas(walk, "pos long, name string, walked long").collect()
    return [(row["pos"], row["name"]) for row in lead], lead[0]["walked"]


def _matched(open_names: DataFrame, heads: list[tuple[int, str]], threshold: float) -> DataFrame:
    """``open_names`` with ``leader_pos``: the first of the leaders that a name is similar to, a whole batch against each."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_names.schema) + ", leader_pos long"

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch["name"].to_numpy(dtype=object)
            found = np.full(len(names), -1, dtype=np.int64)
            rest = np.arange(len(names))
            for i, (_, head) in enumerate(heads):
                near = ratios(names[rest], np.full(len(rest), head, dtype=object)) >= threshold
                found[rest[near]] = i
                rest = rest[~near]
            places = np.array([pos for pos, _ in heads], dtype=np.int64)
            yield batch.assign(leader_pos=pd.Series(places[found], index=batch.index, dtype="Int64").mask(found < 0))

    return cut_lineage(open_names.mapInPandas(match, schema))


def leader_groups(names: DataFrame, threshold: float, budget: Budget = Budget()) -> DataFrame:
    """Greedy leader grouping of (name, pos): name, pos, leader, leader_pos.

    Each name joins the earliest leader with ratio >= threshold, or becomes one.  A round walks the earliest undecided names; if
    the leaders found stand for two names or more each, all names are compared with them.  Otherwise pairs are few,
    and joins settle the names that are among the earliest k of all their tokens; k is eight times as large when a round decided
    less than half of the names, so the number of such rounds grows with the logarithm of the table and not with the leaders.
    A follower of a joined round whose earlier neighbours were not all known is compared once more, with the
    leaders before the one it found.
    """
    todo = cut_lineage(first_by_pos(names.select("name", "pos"), ["name"]))
    open_names, left, least, keyed = todo, todo.count(), budget.per_token, False
    every, checked = todo, True  # names with their tokens, from the first joined round on; whether all are sure
    done: list[DataFrame] = []  # pos, leader_pos, sure
    while left:
        before = left
        heads, walked = _walked(open_names, threshold, budget)
        if 2 * len(heads) <= walked:
            # All names up to the end of the walk are settled, so no earlier leader is unknown.
            judged = _matched(open_names, heads, threshold)
            done.append(judged.filter("leader_pos is not null").select("pos", "leader_pos", F.lit(True).alias("sure")))
            open_names = judged.filter("leader_pos is null").drop("leader_pos")
        else:
            if not keyed:
                every = open_names = cut_lineage(with_prefix(open_names, threshold))
                keyed = True
            edges, partly, k = _first_edges(open_names, threshold, budget, least)
            followers, pending = _settled(edges, partly)
            lead = _except(_except(open_names.select("pos"), "pos", partly), "pos", followers)
            if pending is not None:
                lead = _except(lead, "pos", pending.select(F.col("v").alias("pos")))
            lead = cut_lineage(lead)
            if partly is None:
                led = edges.join(dealt(lead.select(F.col("pos").alias("u"))), "u")
            else:
                own = open_names.join(lead, "pos", "left_semi").withColumn("held", F.col("prefix"))
                led = _similar(_except(open_names, "pos", lead), own, threshold)
            best = led.groupBy(F.col("v").alias("pos")).agg(F.min("u").alias("leader_pos")).withColumn("sure", F.lit(partly is None))
            decided = cut_lineage(best.unionByName(lead.select("pos", F.col("pos").alias("leader_pos"), F.lit(True).alias("sure"))))
            done.append(decided)
            if partly is None:
                break
            checked = False
            open_names = cut_lineage(_except(open_names, "pos", decided))
            least = max(k, least)
        left = open_names.count()
        if 2 * left > before:
            least *= 8
    if not done:
        return todo.select("name", "pos", F.col("name").alias("leader"), F.col("pos").alias("leader_pos"))
    decided = reduce(DataFrame.unionByName, done)
    return _named(todo, decided if checked else _with_earlier_leaders(every, decided, threshold))


def _with_earlier_leaders(every: DataFrame, decided: DataFrame, threshold: float) -> DataFrame:
    """(pos, leader_pos), the followers that are not sure compared with the leaders before the one they found."""
    unsure = decided.filter(~F.col("sure")).select("pos", F.col("leader_pos").alias("best"))
    tokens = every.join(unsure, "pos").select("pos", "best", "name", "prefix", F.explode("prefix").alias("token"))
    leaders = decided.filter("pos = leader_pos").select("pos")
    heads = every.join(leaders, "pos", "left_semi").select(
        F.col("pos").alias("u"), F.col("name").alias("other"), F.col("prefix").alias("shown"), F.explode("prefix").alias("token"))
    near = tokens.join(heads, "token").filter(F.col("u") < F.col("best")).filter(_near("shown", threshold)).select("u", "pos", "name", "other")
    better = near.filter(similarity("name", "other") >= threshold).groupBy("pos").agg(F.min("u").alias("earlier"))
    return decided.join(better, "pos", "left").select("pos", F.coalesce("earlier", "leader_pos").alias("leader_pos"))


def _named(todo: DataFrame, decided: DataFrame) -> DataFrame:
    heads = decided.filter("pos = leader_pos").select("leader_pos").join(
        todo.select(F.col("pos").alias("leader_pos"), F.col("name").alias("leader")), "leader_pos")
    return cut_lineage(todo.select("name", "pos").join(decided.select("pos", "leader_pos"), "pos").join(dealt(heads), "leader_pos").select(
        "name", "pos", "leader", "leader_pos"))


# ---- complete-link grouping

NARROW = 64  # names of at most so many characters are compared bit by bit, many at once
PAIRS = 8192  # pairs of names whose rows stay in a processor's cache
TOKENS = 128  # columns of the bound that spares most pairs the comparison


class _Names:
    """Names that one task compares with those at the places ``others``: which pairs have a ratio of at least ``threshold``."""

    def __init__(self, names: np.ndarray, threshold: float, others: np.ndarray):
        self.names, self.threshold, self.others = names, threshold, others
        self.lengths = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
        seen[flat] = True
        self.blank = int(seen.sum())
        self.flat = (np.cumsum(seen) - 1)[flat]
        self.starts = np.cumsum(self.lengths) - self.lengths
        narrow = np.flatnonzero(self.lengths <= NARROW)
        lengths = self.lengths[narrow]
        # One row for each place in the names, so that a step reads neighbours.
        self.codes = np.full((int(lengths.max(initial=0)), len(names)), self.blank, dtype=np.int64)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.codes[place, np.repeat(narrow, lengths)] = self.flat[np.repeat(self.starts[narrow], lengths) + place]
        self.word = np.uint32 if len(self.codes) <= 32 else np.uint64
        bags, half, self.rest = self._bags(others, choose=True)
        self.right = np.concatenate([bags, -np.ones_like(half), -half], axis=1).T.copy()

    def near(self, ones: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Truth values for the pairs of names at the places ``ones`` and ``others``."""
        out = np.zeros(len(ones), dtype=bool)
        step = max(1, min(PAIRS, (1 << 21) // (self.blank + 1)))
        for at in range(0, len(ones), step):
            out[at:at + step] = self._near(ones[at:at + step], others[at:at + step])
        return out

    def _near(self, ones: np.ndarray, others: np.ndarray) -> np.ndarray:
        total = self.lengths[ones] + self.lengths[others]
        longest = np.maximum(self.lengths[ones], self.lengths[others])
        fits = 2.0 * (total - longest) >= self.threshold * total - EPS
        out = np.zeros(len(ones), dtype=bool)
        rest = np.flatnonzero(fits & (longest > NARROW))
        if len(rest):
            out[rest] = ratios(self.names[ones[rest]], self.names[others[rest]]) >= self.threshold
        rest = np.flatnonzero(fits & (longest <= NARROW))
        if len(rest):
            common = self._common(ones[rest], others[rest])
            out[rest] = np.where(total[rest] == 0, 1.0, 2.0 * common / np.maximum(total[rest], 1)) >= self.threshold
        return out

    def _common(self, ones: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences, one bit for each character of ``ones``."""
        own, at = np.unique(ones, return_inverse=True)
        bits = np.zeros((len(own), self.blank + 1), dtype=self.word)
        each = np.arange(len(own))
        for bit in range(int(self.lengths[own].max())):
            bits[each, self.codes[bit, own]] |= self.word(1 << bit)
        bits[:, self.blank] = 0
        bits, at = bits.ravel(), at * (self.blank + 1)
        row = np.full(len(ones), np.iinfo(self.word).max, dtype=self.word)
        for step in range(int(self.lengths[others].max())):
            hit = row & bits.take(at + self.codes[step].take(others))
            row = (row + hit) | (row - hit)
        # Bits beyond the end of a name are never cleared.
        return np.bitwise_count(~row).astype(np.int64)

    def _bags(self, places: np.ndarray, choose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens (a character for the k-th time) the names at ``places`` have, half of the common ones a pair needs
        for their lengths, and how many tokens of theirs have no column; ``choose`` picks the commonest as columns."""
        lengths = self.lengths[places]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = self.flat[np.repeat(self.starts[places], lengths) + inside]
        if choose:
            often = np.bincount(codes, minlength=self.blank + 1)
            letters = np.argsort(-often)[:min(TOKENS, np.count_nonzero(often))]
            self.column, self.width = np.full(self.blank + 1, len(letters)), len(letters) + 1
            self.column[letters] = np.arange(len(letters))
        counts = np.bincount(np.repeat(np.arange(len(places)), lengths) * self.width + self.column[codes], minlength=len(places) * self.width)
        counts = counts.reshape(len(places), self.width)
        if choose:
            have = [(n, c, level) for level in range(1, min(int(counts.max(initial=0)), 16) + 1)
                    for c, n in enumerate((counts[:, :-1] >= level).sum(axis=0).tolist()) if n]
            self.tokens = np.array(sorted(have, reverse=True)[:TOKENS], dtype=np.int64).reshape(-1, 3)
        bags = (counts[:, self.tokens[:, 1]] >= self.tokens[:, 2]).astype(np.float32)
        return bags, (self.threshold / 2 * lengths).astype(np.float32)[:, None], (lengths - bags.sum(axis=1)).astype(np.float32)

    def blocks(self, ones: np.ndarray, later: bool = False, size: int = 64) -> Iterator[tuple[int, np.ndarray]]:
        """(start, truth values) of blocks of the places ``ones``, one row each, against the others; ``later`` asks for greater places only.

        Names have no longer common subsequence than they have common tokens, which one product of matrices counts for a block.
        """
        bags, half, rest = self._bags(ones)
        left = np.concatenate([bags, half, np.ones_like(half)], axis=1)
        for start in range(0, len(ones), size):
            own = slice(start, min(start + size, len(ones)))
            most = left[own] @ self.right
            if rest[own].any() and self.rest.any():
                most += np.minimum(rest[own, None], self.rest)
            fits = most >= np.float32(-1e-3)
            if later:
                fits &= self.others > ones[own, None]
            row, column = np.nonzero(fits)
            fits[row, column] = self.near(ones[own][row], self.others[column])
            yield start, fits


def _packed(truth: np.ndarray) -> np.ndarray:
    return np.packbits(truth, axis=1, bitorder="little")


def _near_later(known: _Names, ones: np.ndarray) -> np.ndarray:
    """Bits of the later names that each of ``ones``, some of them, is near to."""
    return np.concatenate([_packed(truth) for _, truth in known.blocks(ones, later=True)])


def _walk(near: np.ndarray, at: np.ndarray, numbers: list[int], opened: np.ndarray) -> np.ndarray:
    """Group numbers of names in order, by positions ``at``; ``near`` has a row of bits for each, the later names it is near to.

    ``numbers`` are earlier groups in order, ``opened`` a row of bits for each: the names that are near to all its members.
    """
    count, group = len(numbers), np.zeros(len(at), dtype=np.int64)
    numbers = list(numbers)
    # A column for each group, so that a name finds its first open one among neighbours.
    opens = np.zeros((near.shape[1], count + 64), dtype=np.uint8)
    opens[:, :count] = opened.T
    for one in range(len(at)):
        byte = one >> 3
        hits = opens[byte, :count] & np.uint8(1 << (one & 7))
        first = int(hits.argmax()) if count else 0
        if count and hits[first]:
            opens[byte:, first] &= near[one, byte:]
        else:
            if count == opens.shape[1]:
                opens = np.concatenate([opens, np.zeros_like(opens)], axis=1)
            first, count = count, count + 1
            opens[byte:, first] = near[one, byte:]
            numbers.append(int(at[one]))
        group[one] = numbers[first]
    return group


def _open_groups(known: _Names, numbers: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, bits) of the groups that some names are near to as a whole; members stand group after group, before those names.

    All names are compared with the first member of each group, and those near to all members so far with the next ones."""
    every = known.others
    sizes = np.diff(np.append(starts, every[0]))
    for block, near in known.blocks(starts):
        own, name = np.nonzero(near)
        done, width = 1, 1
        while len(own):
            own, name = (x[sizes[block + own] > done] for x in (own, name))
            lost = np.zeros(len(own), dtype=bool)
            for part in range(0, len(own), 4096):
                few = own[part:part + 4096]
                times = np.minimum(width, sizes[block + few] - done)
                ends = np.cumsum(times)
                pair = np.repeat(np.arange(len(few)), times)
                member = starts[block + few][pair] + done + np.arange(len(pair)) - (ends - times)[pair]
                lost[part + pair[~known.near(member, every[name[part:part + 4096]][pair])]] = True
            near[own[lost], name[lost]] = False
            own, name = own[~lost], name[~lost]
            done, width = done + width, min(2 * width, 64)
        some = np.flatnonzero(near.any(axis=1))
        yield from zip(numbers[block + some].tolist(), _packed(near[some]))


def complete_link_groups(names: DataFrame, threshold: float = 1.0, scope: str | None = None,
                         budget: Budget = Budget()) -> DataFrame:
    """Greedy complete-link grouping of (name, pos): name, pos, group_no (the position of its first name).

    A name joins the first group all of whose members reach the threshold; with ``scope``
    only groups of its own scope.  At the default threshold only equal names do, which is a
    plain aggregate.  Below it similar pairs are never listed, as a family of alike names has the square of its
    size: the names of a scope go chunk after chunk.  Tasks that hold some groups and some names of the chunk each tell in bits which
    names of the chunk are near to them (to groups: as a whole, most fail at the first name); then one task for each scope walks the
    chunk in order over these bits and compares no names.
    ``pos`` must differ between the names of a scope.
    """
    keys = [scope, "name"] if scope else ["name"]
    todo = first_by_pos(names.select(*keys, "pos"), keys)
    if threshold >= 1.0:
        return todo.select(*keys, "pos", F.col("pos").alias("group_no"))
    todo = cut_lineage(todo.withColumn("part", F.col(scope) if scope else F.lit(0)))
    grouped = F.col("part").isNotNull() & F.col("name").isNotNull() & F.col("pos").isNotNull()
    rows = todo.filter(grouped).select("part", "name", F.col("pos").cast("long").alias("pos"))
    per_round = math.isqrt(2 * budget.part_edges) + 1
    rows = number_in_groups(rows, "part", "pos", "row")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    rows = cut_lineage(rows.join(dealt(sizes), "part"))
    last = rows.agg(F.max("row")).first()[0] or 0
    alone = F.col("size") <= min(budget.alone_names, per_round)
    small = _placed_alone(rows.filter(alone), threshold)
    rows, spread = rows.filter(~alone), rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed: list[tuple[int, DataFrame]] = []  # rounds and their names
    for start in range(0, last if last > min(budget.alone_names, per_round) else 0, per_round):
        chunk = rows.filter(F.col("row").between(start + 1, start + per_round))
        # Parts that end before this chunk have nothing to ask.
        earlier = [df.filter(F.col("size") > start) for _, df in placed]
        placed.append((1, _placed_chunk(chunk, earlier, threshold, budget)))
        while len(placed) > 1 and placed[-1][0] == placed[-2][0]:
            # Few tables hold many rounds, each written once for every doubling.
            (n, one), (_, two) = placed.pop(), placed.pop()
            placed.append((2 * n, cut_lineage(two.unionByName(one).coalesce(int(spread)))))
    done = reduce(DataFrame.unionByName, [small, *(df.drop("size") for _, df in placed)])
    own = [F.col("part").alias(scope)] if scope else []
    done = done.select(*own, "name", F.col("pos").cast(todo.schema["pos"].dataType).alias("pos"), "group_no")
    return todo.filter(~grouped).select(*keys, "pos", F.col("pos").cast("long").alias("group_no")).unionByName(done)


def _placed_alone(rows: DataFrame, threshold: float) -> DataFrame:
    """part, name, pos, group_no of parts with few names, each walked by the task that compares its names."""
    part = rows.schema["part"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        every = np.arange(len(rows))
        near = _near_later(_Names(rows["name"].to_numpy(dtype=object), threshold, every), every)
        return rows[["part", "name", "pos"]].assign(group_no=_walk(near, rows["pos"].to_numpy(), [], np.zeros((0, near.shape[1]), dtype=np.uint8)))

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = rows.select("part", "name", "pos", "row").repartition(spread, "part").groupBy("part")
    return cut_lineage(walked.applyInPandas(walk, f"part {part}, name string, pos long, group_no long"))


def _placed_chunk(chunk: DataFrame, placed: list[DataFrame], threshold: float, budget: Budget) -> DataFrame:
    """part, name, pos, size, group_no of the next names (part, name, pos, row, size) of each part; ``placed`` are those of earlier chunks."""
    part = chunk.schema["part"].dataType.simpleString()
    spread = int(chunk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = F.least(F.ceil(F.col("size") / budget.bucket_names), F.lit(budget.group_buckets)).cast("int")
    # The names of the chunk go to every bucket of their part; each bucket answers for a share of them and of the groups.
    asked = chunk.select("part", "name", "row", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), buckets.alias("buckets"))
    none = chunk.select("part", "name", "pos", F.col("pos").alias("group_no"), "size").filter(F.lit(False))
    # Each group lies in one bucket with all its members.
    members = reduce(DataFrame.unionByName, placed or [none]).select(
        "part", F.pmod(F.xxhash64("group_no"), buckets).cast("int").alias("bucket"), "name", "pos", "group_no")

    def ask(key: tuple, held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(asking):
            held, asking = held.sort_values(["group_no", "pos"]), asking.sort_values("row")
            every, row = np.arange(len(held), len(held) + len(asking)), asking["row"].to_numpy()
            known = _Names(np.concatenate([held["name"].to_numpy(dtype=object), asking["name"].to_numpy(dtype=object)]), threshold, every)
            if len(held):
                numbers, starts = np.unique(held["group_no"].to_numpy(), return_index=True)
                found += [(number, False, bits.tobytes()) for number, bits in _open_groups(known, numbers, starts)]
            own = np.flatnonzero(row % asking["buckets"].iloc[0] == key[1])
            if len(own):
                found += [(number, True, bits.tobytes()) for number, bits in zip(row[own].tolist(), _near_later(known, every[own]))]
        out = pd.DataFrame(found, columns=["number", "own", "bits"])
        return out.assign(part=pd.Series(np.full(len(out), key[0], dtype=object), dtype=object))[["part", "number", "own", "bits"]]

    def walk(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.sort_values("row", ignore_index=True), found.sort_values("number")
        own = found["own"].to_numpy(dtype=bool)
        bits = lambda some: np.frombuffer(b"".join(found["bits"][some]), dtype=np.uint8).reshape(int(some.sum()), -(-len(rows) // 8))
        numbers = _walk(bits(own), rows["pos"].to_numpy(), found["number"][~own].tolist(), bits(~own))
        return rows[["part", "name", "pos", "size"]].assign(group_no=numbers)

    by = lambda df, *keys: df.repartition(spread, *keys).groupBy(*keys)
    found = by(members, "part", "bucket").cogroup(by(asked, "part", "bucket")).applyInPandas(ask, f"part {part}, number long, own boolean, bits binary")
    walked = by(chunk, "part").cogroup(by(found, "part"))
    return cut_lineage(walked.applyInPandas(walk, f"part {part}, name string, pos long, size long, group_no long"))

"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .filter_audit import op13_filter_audit
from .host_rules import op8_host_rules
from .line_dedup import op4_line_dedup
from .packing import op7_best_fit_packing
from .fingerprints import op6_fingerprints
from .personal_data import op12_personal_data
from .pieces import op10_pieces
from .quality_classifier import op5_quality_classifier
from .simhash import op1_simhash
from .substring_dedup import op9_substring_dedup
from .token_counts import op2_token_counts
from .token_output import op3_token_output
from .whitening import op11_whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, below $TOKENIZERS_DIR where that is set."""
    if os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers
    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash, op2_token_counts, op3_token_output, op4_line_dedup, op5_quality_classifier, op6_fingerprints, op7_best_fit_packing,
        op8_host_rules, op9_substring_dedup, op10_pieces, op11_whitening, op12_personal_data, op13_filter_audit)}


_WORDS = r"""
w as (select *, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as ws from documents)"""

_HOST_RULES = "with " + _WORDS + r""",
e as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as t from e),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as times from g) where times > 1),
c as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from r) group by doc_id),
n as (select w.doc_id, source, len(ws) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from (select *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as lines from w) w
  left join c on c.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from n),
f as (select *, base_failed or 10 * n_symbols > n_words or 5 * n_dup_lines > n_words or word_chars < 3 * n_words or word_chars > 12 * n_words as failed from b),
h as (select source, count(*) as n, count(*) filter (where failed) as bad from f group by source),
s as (select count(*) as k, cast(sum(n) as double) as n, cast(sum(bad) as double) / cast(sum(n) as double) as mean,
  sum(cast(bad as double) * bad / n) as squares, cast(sum(n * n) as double) as sizes from h),
v as (select *, case when k > 1 and n > sizes / n then (squares - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - sizes / n) else 0 end as between_hosts from s),
p as (select mean, case when mean > 0 and mean < 1 and between_hosts > 0 then least(n, greatest(1.0, mean * (1 - mean) / between_hosts - 1)) else n end as weight from v)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (bad + greatest(mean * weight, 1e-9)) / (h.n + greatest(mean * weight, 1e-9) + greatest((1 - mean) * weight, 1e-9)) <= 0.5 as kept
from f join h on h.source is not distinct from f.source cross join p"""

_REPEATS = "with " + _WORDS + r""",
e as (select doc_id, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35),
g as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as t from e),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by t) as times from g) where times > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) as k from r),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as k from w),
k as (select x.doc_id, count(*) as n_words, count(c.k) as n_removed, string_agg(word, ' ' order by x.k) filter (where c.k is null) as kept
  from x left join c on c.doc_id = x.doc_id and c.k = x.k group by x.doc_id)
select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id"""


_FILTER_AUDIT = "with " + _WORDS + r""",
d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, len(ws) as words, len(list_distinct(ws)) as different,
  min(doc_id) over (partition by coalesce(text, '')) as least from w),
m as (select doc_id, part, case when words < 200 then 1 else 0 end + case when 100 * different < 50 * words then 2 else 0 end
  + case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > least then 16 else 0 end as mask from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
s as (select part, cast(subset as integer) as subset, sum(case when mask & subset = 0 then n else 0 end) as n, sum(case when mask & subset = 0 then good else 0 end) as good,
  sum(case when mask & subset = 0 then toxic else 0 end) as toxic from c, (select unnest(range(32)) as subset) group by part, subset),
f as (select unnest(range(5)) as f),
o as (select a.f as a, b.f as b, c.f as c, d.f as d, e.f as e from f a, f b, f c, f d, f e
  where (1 << a.f) | (1 << b.f) | (1 << c.f) | (1 << d.f) | (1 << e.f) = 31),
p as (select 'ABCDE'[a + 1] || 'ABCDE'[b + 1] || 'ABCDE'[c + 1] || 'ABCDE'[d + 1] || 'ABCDE'[e + 1] as filter_order, unnest([
  {'step': 1, 'f': a, 'before': 0}, {'step': 2, 'f': b, 'before': 1 << a}, {'step': 3, 'f': c, 'before': (1 << a) | (1 << b)},
  {'step': 4, 'f': d, 'before': (1 << a) | (1 << b) | (1 << c)}, {'step': 5, 'f': e, 'before': 31 - (1 << e)}]) as x from o),
r as (select u.part, filter_order, x.step, x.f, v.n as kept, u.n - v.n as removed, u.good - v.good as good_lost, u.toxic - v.toxic as toxic_lost
  from p join s u on u.subset = x.before join s v on v.part = u.part and v.subset = x.before | (1 << x.f))
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(z.n - i.n - removed as bigint) as redundant, cast(j.n - k.n as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by r.part, r.f) as bigint) as shapley
from r join s z using (part) join s i using (part) join s j using (part) join s k using (part)
where z.subset = 0 and i.subset = 1 << r.f and j.subset = 31 - (1 << r.f) and k.subset = 31"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that joins and groups can express; tokenizers, boosted tables, hashes of 64 bits
    and alignments are tested against brute force instead."""
    return {"op8_host_rules": _HOST_RULES, "op9_substring_dedup": _REPEATS, "op13_filter_audit": _FILTER_AUDIT}

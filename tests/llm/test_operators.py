"""The operators beside brute force, on the smallest tables and on small odd ones."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

from tallyline.llm import chunks, fingerprints as fp, host_rules as hr, line_dedup as ld, packing as pk, pieces as pc
from tallyline.llm import quality_classifier as qc, simhash as sh, substring_dedup as sd, token_counts as tc, token_output as to
from tallyline.llm.common import components, new_folder
from tallyline.llm.queries import queries, tokenizer

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows, columns that clash with results."""
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", " \n\t ", "one", "one two", long, long + " end", passage, "before " + passage + " after", "a b a b a b a b",
             "same line of thirty characters or more\nother", "same line of thirty characters or more\nsecond", "é☃\n\n漢字 ▁ <|endoftext|>"]
    rows = [(i, t, None, "h" if i % 2 else None, "clash") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[8], (None, "one", None, None, "clash"), (None, None, None, None, None), (10, "other text, same id", None, "h", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return SPACE.findall(text or "")


# ---- helpers

def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, i) for i in range(6000, 6100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1

def brute_fingerprint(text, k):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """prints: list of (id, fingerprint) -> list of component ids, by comparing all fingerprints."""
    distinct = sorted({f for _, f in prints})
    label = {f: f for f in distinct}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                label[root(b)] = root(a)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [least.get(root(f)) for _, f in prints]


def test_every_near_pair_collides_in_some_table():
    for radius in (1, 2, 3):
        masks = sh.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(3000):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), radius):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("radius", [2, 4])
def test_links_connect_what_all_pairs_connect(spark, radius):
    rng = random.Random(radius)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, radius + 1)):
                x ^= 1 << b
    prints = sorted(prints)
    frame = spark.createDataFrame([(sh._signed(p),) for p in prints], "fp long")
    edges = sh.near_links(frame, radius)
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= radius for r in edges.collect())
    label = {r["node"] % 2**64: r["root"] for r in components(edges).collect()}
    want = collections.defaultdict(set)
    for p, c in zip(prints, brute_groups([(p, p) for p in prints], radius)):
        want[c].add(p)
    got = collections.defaultdict(set)
    for p in prints:
        got[label.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_the_table_and_odd_rows(spark, docs, odd, none):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries()["op1_simhash"](spark, SF).collect()}
    prints = [(i, brute_fingerprint(t, 3)) for i, t in docs.items()]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute_groups(prints, 2))}
    rows = [(r["doc_id"], brute_fingerprint(r["text"], 5)) for r in odd.collect()]
    want = collections.Counter((i, sh._signed(f), c) for (i, f), c in zip(rows, brute_groups(rows, 2)))
    assert collections.Counter(map(tuple, sh.near_groups(odd).collect())) == want
    assert sh.near_groups(none).count() == 0 and sh.drop_near_copies(none).count() == 0
    kept = sh.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None})


def test_texts_under_one_id_are_kept_apart(spark):
    copy, own, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, copy), (7, copy), (7, own), (7, own), (7, other), (None, own), (None, "without id"), (None, "without id")]
    kept = sh.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), per_id=False)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, copy), (7, own), (7, other), (None, "without id")], key=str)


# ---- 2, 10

def odd_texts():
    rng = random.Random(1)
    letters = list("ab c.,'s3\n\t éÿÅ☃漢!?<|>") + ["\x00", "▁", "  ", "<|endoftext|>", "<|startoftext|>", "...", " ", "\x1c", "İ", "Σ", "'ll", "12.5", "é", "\n\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 2000, "ab" * 1000 + " x", "", "thea" * 30, None]


def test_token_counts_are_the_librarys(spark, docs, odd, none):
    import sentencepiece
    model = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = odd_texts()
    assert tc.merger(model).text_counts(texts) == [len(library.encode(t or "")) for t in texts]
    for r in queries()["op2_token_counts"](spark, SF).collect():
        text, n = docs[r["doc_id"]], len(library.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
    counted = tc.token_counts(odd, model, 4096)
    assert counted.columns == [*odd.columns, "n_bytes", "n_tokens", "over_limit"]
    for r in counted.collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "")) and r["over_limit"] == (r["n_tokens"] > 4096)
    assert tc.token_counts(none, model, 4096).count() == 0


def test_long_chunks_merge_as_short_ones():
    merger = tc.merger(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(5)
    some = ["".join(rng.choice("thea▁inof☃") for _ in range(rng.randint(1, 47))) for _ in range(800)]
    assert merger._arrays(some).tolist() == [merger._heap(c) for c in some]


def test_pieces_have_the_best_score_and_give_the_text_back(spark, odd, none):
    model = tokenizer("piece_bpe_32k.model")
    auto = pc.automaton(model)
    score = {p: s for p, s, kind in auto.vocabulary if kind == 1}
    longest = max(map(len, score))

    def best(text):
        """By definition: over all ends and all pieces."""
        at = [0.0]
        for end in range(1, len(text) + 1):
            found = [at[end - k] + score[text[end - k:end]] for k in range(1, min(longest, end) + 1) if text[end - k:end] in score]
            if text[end - 1] not in score:
                found.append(at[end - 1] + auto.unknown_score)
            at.append(max(found))
        return at[-1]

    value = {i: s for i, (_, s, _) in enumerate(auto.vocabulary)}
    for text in odd_texts()[:800]:
        if not text:
            continue
        whole = "▁" + text.replace(" ", "▁")
        ids = np.frombuffer(auto.encode([text])[0], dtype="<i4").tolist()
        unknown = sum(c not in score for c in whole)
        got = sum(value[i] for i in ids if i not in auto.byte_of) + unknown * auto.unknown_score
        assert got == pytest.approx(best(whole), rel=1e-12)
        assert auto.decode(ids) == text.replace("▁", " ")
    got = pc.decode_pieces(pc.encode_pieces(odd, model), model).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert all(r["round_trip"] for r in queries()["op10_pieces"](spark, SF).collect())
    assert pc.encode_pieces(none, model).count() == 0
    assert auto.encode([None, ""]) == [b"", b""] and auto.decode([]) == ""


# ---- 3, 7

def test_long_texts_are_taken_in_stretches(monkeypatch):
    import sentencepiece
    texts = odd_texts()
    monkeypatch.setattr(chunks, "LONG_TEXT", 40)
    monkeypatch.setattr(tc, "LONG_TEXT", 40)
    model = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    assert tc.merger(model).text_counts(texts) == [len(library.encode(t or "")) for t in texts]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = chunks.LibraryEncoder(tokenizer(name))
        whole = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert encoder.encode(texts) == whole


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_ids_are_the_librarys(name):
    encoder = chunks.LibraryEncoder(tokenizer(name))
    texts = odd_texts()
    whole = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.kind != "whole" and encoder.encode(texts) == whole


def test_token_files_hold_the_librarys_ids(spark, docs, odd, none):
    encoder = chunks.LibraryEncoder(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries()["op3_token_output"](spark, SF).collect()}
    start = 0
    for i in sorted(docs):
        ids = [*encoder.tokenizer.encode(docs[i], add_special_tokens=False).ids, 2]
        r = got.pop(i)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert not got
    path = new_folder(spark)
    to.write_tokens(odd, path, tokenizer("word_bpe_49k.json"), 2)
    rows = sorted(to.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count() and [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    assert to.find_tokens(spark, path, [4, 3]).count() == 4
    assert "PushedFilters: [In(doc_id" in to.find_tokens(spark, path, [4, 3])._jdf.queryExecution().toString()
    path = new_folder(spark)
    to.write_tokens(none, path, tokenizer("word_bpe_49k.json"), 2)
    assert to.read_tokens(spark, path).count() == 0


def packed(rows, tokens):
    """Checks pieces and sequences; the number of sequences."""
    sequences, per_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= tokens
    return len(sequences), per_doc


def test_packing_of_the_table(spark, docs):
    encoder = chunks.LibraryEncoder(tokenizer("byte_bpe_50k.json"))
    rows = queries()["op7_best_fit_packing"](spark, SF).collect()
    number, per_doc = packed(rows, 2048)
    ids = {i: [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for i, found in per_doc.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(found)):
            assert (piece, start) == (k, at) and (length == 2048 or k == 0)
            at += length
        assert at == len(ids[i])
    assert set(per_doc) == set(docs)
    assert number <= -(-sum(map(len, ids.values())) // 2048) * 1.01 + 1


def test_packing_of_odd_rows(spark, odd, none):
    rows = pk.pack_documents(odd, tokenizer("byte_bpe_50k.json"), tokens=64).collect()
    packed(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert pk.pack_documents(none, tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = random.Random(2)
    counts = collections.Counter(rng.choice([1, 3, 50, 200, rng.randint(1, 500)]) for _ in range(4000))
    groups = pk.plan(counts, 512, documents=6, attention=90_000, weights=(1.0, 0.5, 0.5), score=score) if max(counts) <= 300 else \
        pk.plan(counts, 512, documents=6, attention=250_000, weights=(1.0, 0.5, 0.5), score=score)
    used = collections.Counter()
    for lengths, n in groups:
        assert sum(lengths) <= 512 and len(lengths) <= 6 and sum(x * x for x in lengths) <= 250_000
        for x in lengths:
            used[x] += n
    assert used == counts
    with pytest.raises(ValueError):
        pk.plan({600: 1}, 512)


def test_packing_is_best_fit_decreasing():
    """Against placing piece by piece."""
    rng = random.Random(4)
    counts = collections.Counter(rng.randint(1, 100) for _ in range(600))
    rest = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [i for i, r in enumerate(rest) if r >= length]
        if fits:
            rest[min(fits, key=lambda i: rest[i])] -= length
        else:
            rest.append(100 - length)
    assert sum(n for _, n in pk.plan(counts, 100)) == len(rest)


# ---- 4

def test_patience_deletes_aligned_blocks_of_the_later_document(spark):
    line = [f"this is line number {i} with enough characters" for i in range(30)]
    rows = [(1, "\n".join(line[:10])),
            (2, "\n".join(["new opening line that nobody has", *line[2:6], "new line between the blocks", *line[7:9]])),
            (3, "\n".join([line[9], "new middle line of the third one", line[0]])),  # crossed: one of the two is aligned
            (4, "\n".join(line[:10])), (5, "x\ny"), (6, "x\nz"),  # short blocks stay
            (7, "\n".join([line[20], "", line[21]])), (8, "\n".join([line[20], "", line[21], "end"]))]
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["kept_text"]) for r in ld.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (10, 0, rows[0][1])
    assert got[2] == (8, 6, "new opening line that nobody has\nnew line between the blocks")
    assert got[3][:2] == (3, 1)
    assert got[4] == (10, 10, "")
    assert got[5][1] == got[6][1] == 0
    assert got[8] == (3, 2, "end")


def test_patience_aligns_as_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            if b and rng.random() < .5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.randrange(12, 20))
        pairs = ld.patience(dict(enumerate(a)), dict(enumerate(b)))
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))
        if len(set(a)) == len(a):  # all lines unique: every surviving line is aligned
            assert len(pairs) == len(set(a) & set(b))


def test_line_removal_keeps_every_line_somewhere(spark, docs, odd, none):
    rows = {r["doc_id"]: r for r in ld.remove_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(rows) == set(docs)
    kept = {line for r in rows.values() for line in r["kept_text"].split("\n") if line.strip()}
    assert kept == {line for t in docs.values() for line in t.split("\n") if line.strip()}
    first = {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            first.setdefault(line, i)
    for i, r in rows.items():  # what a first holder has, it keeps
        own = collections.Counter(x for x in docs[i].split("\n") if first[x] == i and x.strip())
        assert own - collections.Counter(r["kept_text"].split("\n")) == collections.Counter()
    copies = collections.Counter(docs.values())
    for i, t in docs.items():
        if copies[t] > 1 and len(t) > 60 and i != min(j for j, x in docs.items() if x == t):
            assert rows[i]["n_deleted"] == rows[i]["n_lines"] or any(first[x] != min(j for j, y in docs.items() if y == t) for x in t.split("\n"))
    got = ld.remove_lines(odd)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "n_lines", "n_deleted", "kept_text"]
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert by[(11, "same line of thirty characters or more\nsecond")]["kept_text"] == "second"
    assert by[(None, None)]["kept_text"] == "" and by[(0, None)]["n_lines"] == 0
    assert ld.remove_lines(none).count() == 0


def test_blocks_held_whole_by_later_holders_go(spark, docs):
    a, b = "a line of more than thirty characters", "and another line of such a length"
    short = [f"short {i}" for i in range(8)]
    rows = [(1, f"{b}\n{a}"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}"),
            *[(4 + i, f"{x}\nend of {i}") for i, x in enumerate(short)],  # first holders of one short line each
            (20, "\n".join(["opening", *short, "closing"])), (21, "\n".join(["its own opening", *short[:4], "", *short[4:], "its own closing"])),
            (22, "\n".join(short[::-1]))]  # no two of them side by side anywhere
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["kept_text"]) for r in ld.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (2, 0, rows[0][1]) and got[2][1] == 1
    assert got[3] == (2, 2, "")
    assert got[20][1] == 0
    assert got[21] == (10, 8, "its own opening\nits own closing")
    assert got[22][1] == 0
    rows = {r["doc_id"]: r for r in ld.remove_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    least = {}
    for i in sorted(docs):
        least.setdefault(docs[i], i)
    for i, t in docs.items():  # nothing stays of a copy
        lines = [x for x in t.split("\n") if x.strip()]
        if i != least[t] and sum(map(len, lines)) >= 30 and len(lines) > 1:
            assert rows[i]["n_deleted"] == rows[i]["n_lines"] == len(lines)


# ---- 5

def test_classifier_on_held_out_labels(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries()["op5_quality_classifier"](spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    test = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert len(test) > 80 and sum(p == y for p, y in test) / len(test) > 0.95
    good = [p for p, y in test if y == 1]
    assert sum(good) / len(good) > 0.98
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, None), (99, 1), (None, 0)], "doc_id long, quality int")
    scored = qc.classify(odd, labels)
    assert scored.count() == odd.count() and scored.filter("score is null or held_out is null").count() == 0
    no_labels = labels.limit(0)
    assert {r["score"] for r in qc.classify(odd, no_labels).collect()} == {0.5}
    assert qc.classify(none, labels).count() == 0


def test_scores_add_bins():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = qc.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    one = x[2000]
    total = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, one))
    low = [np.searchsorted(e, v, side="right") for e, v in zip(model.pair_edges, one)]
    total += sum(t[low[a], low[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
    assert model.margins(one[None])[0] == pytest.approx(total)


# ---- 6

def test_fingerprints_are_homomorphic(spark):
    rows = [(1, "first one.\nsecond two.\nthird three."), (2, "third three.\nfirst one.\nsecond two."), (3, "second two."), (4, "first one.\nthird three."), (5, "")]
    got = {r["k"]: r["vector"] for r in fp.vectors(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert got[1] == got[2] != got[4] and got[5] == [0] * 256
    frame = spark.createDataFrame([(got[1], got[3], got[4])], "a array<long>, b array<long>, c array<long>")
    r = frame.select(fp.changed(F.col("a"), F.col("b"), -1).alias("less"), fp.changed(F.col("c"), F.col("b")).alias("more")).first()
    assert r["less"] == got[4] and r["more"] == got[1]


def test_fingerprints_of_the_table(spark, docs):
    rows = {r["doc_id"]: r for r in queries()["op6_fingerprints"](spark, SF).collect()}
    order = sorted(docs)
    by_text = {}
    for i, n in zip(order, [*order[1:], order[0]]):
        t, r = docs[i], rows[i]
        q = len(t) // 4
        edited = t[:len(t) - q] + docs[n][:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 1024
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)
    assert len(rows) == len(docs)
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in rows.values()])


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = fp.fingerprints(odd).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    rows = sorted(odd.collect(), key=key)
    want = collections.Counter()
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        t, m = r["text"] or "", n["text"] or ""
        q = len(t) // 4
        want[(r["doc_id"], len(t), hashlib.sha256((t[:len(t) - q] + m[:q]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert fp.fingerprints(none).count() == 0
    alone = fp.fingerprints(odd.filter("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0]["next_vector"] == alone[0]["vector"]


# ---- 8

def brute_counts(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            hit[i:i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit))


def test_host_rules(spark, docs, odd, none):
    rows = queries()["op8_host_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = brute_counts(docs[r["doc_id"]])
        assert tuple(r[c] for c in hr.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    got = hr.judge(odd).collect()
    assert len(got) == odd.count() and all(tuple(r[c] for c in hr.COUNTS) == brute_counts(r["text"]) for r in got)
    assert hr.judge(none).count() == 0


def test_host_verdicts_shrink_small_hosts(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(f"clean{h}", good) for h in range(20) for _ in range(50)] + [("bad", "short")] * 45 + [("bad", good)] * 5 + [("tiny", "short"), ("tiny", good)]
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {(r["source"], r["base_failed"]): (r["kept"], r["host_rate"]) for r in hr.judge(rows).collect()}
    assert got[("clean3", False)][0] and not got[("bad", False)][0] and got[("bad", False)][1] > 0.8
    assert got[("tiny", False)][0] and got[("tiny", False)][1] < 0.5  # 1 of 2, drawn to the others' rate
    assert hr.prior(0, 0, 0, 0.0, 0) == (0.5, 0.5)
    a, b = hr.prior(10, 1000, 100, 10.0, 100_000)  # all hosts alike: one rate for all
    assert a / (a + b) == pytest.approx(0.1) and a + b == pytest.approx(1000)


# ---- 9

def brute_removed(texts, window):
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substrings_of_the_table(spark, docs):
    ids = list(docs)
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in zip(ids, brute_removed([docs[i] for i in ids], 35))}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op9_substring_dedup"](spark, SF).collect()}
    assert got == want and any(k for _, k, _ in want.values())


@pytest.mark.parametrize("most", [2, 64])
def test_substrings_of_small_alphabets(spark, most):
    """Many overlapping repeats; with ``most`` 2 nearly every anchor is split."""
    rng = random.Random(most)
    base = [rng.choice("abc") for _ in range(60)]
    texts = []
    for _ in range(60):
        at, n = rng.randrange(50), rng.randint(0, 30)
        texts.append(" ".join([rng.choice("abcdefg") for _ in range(rng.randint(0, 8))] + base[at:at + n] + [rng.choice("xyz") for _ in range(rng.randint(0, 8))]))
    texts += [" ".join(["a"] * 40), " ".join(["a"] * 9), texts[0], texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in sd.remove_repeats(frame, window=7, anchor=3, most_segments=most).collect()}
    assert got == dict(enumerate(brute_removed(texts, 7)))


def test_substrings_of_odd_rows(spark, odd, none):
    rows = odd.collect()
    want = collections.Counter((r["doc_id"], *w) for r, w in zip(rows, brute_removed([r["text"] for r in rows], 35)))
    got = sd.remove_repeats(odd)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == want
    for r in got.filter("n_removed > 0").collect():
        assert sum(b - a for a, b in r["removed_spans"]) == r["n_removed"]
    assert sd.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(none, window=100, anchor=8)


def test_suffix_automaton_counts_occurrences():
    rng = random.Random(8)
    for _ in range(60):
        seqs = [([rng.randrange(3) for _ in range(rng.randint(1, 15))], rng.randint(1, 2)) for _ in range(4)]
        auto = sd.SuffixAutomaton()
        for s, n in seqs:
            auto.add(s, n)
        auto.settle()
        window = 3
        counts = collections.Counter()
        for s, n in seqs:
            for i in range(len(s) - window + 1):
                counts[tuple(s[i:i + window])] += n
        for s, _ in seqs:
            bits = auto.repeated(s, window)
            assert bits == sum(1 << i for i in range(len(s) - window + 1) if counts[tuple(s[i:i + window])] > 1)

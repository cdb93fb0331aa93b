"""The operators of gradus.llm against brute force, exact round trips and held-out labels, with odd rows of every kind."""

import hashlib
import math
import random
import re
import textwrap
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import duckdb  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gradus.llm import bpe, chat, decontaminate, jaccard, licences, quality, queries, rules, secretscan, shingles, textstats, tokens, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "one", "a b c d", "Ωμέγα  straße\x0b日本語", "x" * 5000, "a b c d e f", "A B C d e f", "same line\nsame line\nsame line"]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, None, len(t or "")) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns of clashing names
        for name in ("n_words", "kept", "size", "ids", "label", "id", "words", "score", "spans", "met", "rank"):
            made = made.withColumn(name, F.lit("extra"))
    return made


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n, quality_of=lambda i: 1, toxic_of=lambda i: 0):
    return spark.createDataFrame([(i, quality_of(i), toxic_of(i)) for i in range(n)] or [], "doc_id long, quality int, toxic int")


# 10 quality rules


def brute_stats(text):
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^ \t-\r]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice)


def test_stats():
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "c#", "d\n", "e|", " "]) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    for t in texts:
        assert textstats.stats(t)[:5] == brute_stats(t), t


def test_binomial_tail():
    for n, k, p in ((10, 0, 0.3), (50, 3, 0.1), (400, 20, 0.05), (7, 7, 0.5)):
        assert rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_rules(spark):
    rng = random.Random(1)
    clean = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(80)) for _ in range(2400)]
    junk = [" ".join(f"w{rng.randint(0, 5000)}***" for _ in range(80)) for _ in range(300)]
    docs = frame(spark, clean + junk, extra=True).withColumn("lang", F.lit("en"))
    good = labels(spark, len(clean))
    cutoffs = rules.certify(rules.measure(docs.select("doc_id", "lang", "text")), good)
    stratum, *chosen = cutoffs[0]
    assert stratum == "en" and len(cutoffs) == 1
    counts = {i: textstats.stats(t) for i, t in enumerate(clean)}
    for rule, cutoff in zip(rules.RULES, chosen, strict=True):
        top, bottom = textstats.NAMES.index(rule.top), textstats.NAMES.index(rule.bottom)
        tails = [rules.binomial_tail(sum(c[top] > x * c[bottom] for c in counts.values()), len(clean), 0.03 / len(rules.RULES)) for x in rule.cutoffs]
        fine = next((j for j, p in enumerate(tails) if p > 0.05 / len(rules.RULES)), len(tails))
        assert cutoff == (rule.cutoffs[fine - 1] if fine else None)
    kept = {r.doc_id for r in rules.keep(docs, good).collect()}
    assert len(kept & set(range(len(clean)))) >= 0.97 * len(clean) and not kept & set(range(len(clean), len(clean) + len(junk)))
    assert rules.keep(docs, good).columns == docs.columns


def test_rules_odd_rows(spark):
    docs = frame(spark, [*ODD, "word " * 3 + " ".join(map(str, range(60)))] * 2, extra=True)
    docs = docs.withColumn("__stats", F.lit("extra")).withColumn("__kept", F.lit("extra"))
    got = rules.keep(docs, labels(spark, 0)).collect()
    assert {(r["__stats"], r["__kept"], r.rank) for r in got} == {("extra",) * 3}
    assert sorted(r.doc_id for r in got) == [10, 21]
    assert rules.keep(empty(spark), labels(spark, 3)).count() == 0


def test_certified_steps():
    assert rules.certified_steps([[0.001, 0.02, 0.3], [0.04, 0.04, 0.04]], 0.05) == [2, 0]
    assert rules.certified_steps([[0.001, 0.02, 0.02], [0.04, 0.04, 0.2]], 0.05) == [3, 2]  # the first leaves its share to the second
    assert rules.certified_steps([], 0.05) == []


def test_rules_pool_strata_of_few_labels(spark):
    rng = random.Random(5)
    clean = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(360)]
    junk = [" ".join(f"w{rng.randint(0, 5000)}***" for _ in range(60)) for _ in range(12)]
    docs = frame(spark, clean + junk).withColumn(
        "lang", F.when(F.col("doc_id") < 200, "en").when(F.col("doc_id") % 3 == 0, "fr").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("x"), F.col("doc_id")))
    )
    measured = rules.measure(docs)
    found = rules.certify(measured, labels(spark, 360))
    assert [x[0] for x in found] == ["en", rules.POOLED] and all(x[1:] == tuple(r.cutoffs[-1] for r in rules.RULES) for x in found)
    kept = {r.doc_id for r in rules.verdict(measured, found).where("__kept").collect()}
    assert kept == set(range(360))
    assert rules.certify(measured, labels(spark, 90)) == []  # too few for any bound: base rules alone


def test_rules_query_rejects_by_certified_cutoffs(spark):
    """At sf0.01 rows go by certified cutoffs; the bound is recomputed from the labels by brute force."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, sf).collect()}
    gone = [i for i, r in got.items() if not r.base_failed and not r.kept]
    assert len(gone) >= 40
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    passing = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in good and not got[r.doc_id].base_failed}
    for own in (lambda x: x == "en", lambda x: x != "en"):  # the one language with labels enough, and the pool
        those = [i for i, x in passing.items() if own(x)]
        lost, n = sum(not got[i].kept for i in those), len(those)
        assert sum(math.comb(n, k) * 0.03**k * 0.97 ** (n - k) for k in range(lost + 1)) <= 0.05
        assert any(own(r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(gone)).collect())


# 1 quality classifier


def test_quality(spark):
    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randint(0, 900)}" for _ in range(rng.randint(60, 200))) + "." for _ in range(300)]
    texts += [" ".join(["spam!!"] * rng.randint(50, 200)) for _ in range(60)] + ODD
    docs = frame(spark, texts, extra=True)
    marks = labels(spark, 360, quality_of=lambda i: int(i < 300)).where("doc_id % 3 > 0")
    measured = quality.measure(docs)
    model = quality.fit(measured, marks)
    got = {r.doc_id: r.score for r in quality.score(measured, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.7) == (i < 300) for i in range(0, 360, 3))
    # the model is the plain regularised discriminant of the labelled rows
    x = quality.transform(np.array([textstats.stats(t) for t in texts[:360]]))
    own = [i for i in range(360) if i % 3 and i < 300]
    assert np.allclose(model.means[1], x[own].mean(axis=0))
    cov = np.cov(x[own].T)
    spread = np.maximum(np.diag(cov), 1e-4)
    want = 0.95 * (cov + np.diag(spread - np.diag(cov))) + 0.05 * np.diag(spread)
    factor = np.linalg.inv(model.inverse_factors[1])
    assert np.allclose(factor @ factor.T, want, rtol=1e-4, atol=1e-7)


def test_quality_without_labels(spark):
    measured = quality.measure(frame(spark, ODD))
    model = quality.fit(measured, labels(spark, 0))
    assert {r.score for r in quality.score(measured, model).collect()} == {0.5}
    assert quality.score(quality.measure(empty(spark)), model).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)])
def test_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col(label)), F.count("*")).first()
    assert right >= least * n


# 2 byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*queries.tokenizer())


@pytest.fixture(scope="module")
def reference_bpe():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.tokenizer()[0].splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(codec, reference_bpe):
    rng = random.Random(2)
    texts = [x or "" for x in ODD] + ["a" * 3001, "#" * 999 + "ab" * 500, " " * 500 + "x", "<|endoftext|> it's", "".join(rng.choice("théè") for _ in range(3000))]
    texts += ["".join(chr(c) + " " + chr(c) * 2 + "a1" for c in range(i, i + 500) if not 0xD800 <= c < 0xE000) for i in range(1, 0x3000, 500)]
    encoded = codec.encode(texts)
    for t, x in zip(texts, encoded, strict=True):
        assert x == np.array(reference_bpe.encode_ordinary(t), dtype="<u4").tobytes(), t[:40]
    assert codec.decode(encoded) == [t.encode() for t in texts]
    with pytest.raises(ValueError, match="vocabulary"):
        codec.decode([np.array([10**6], dtype="<u4").tobytes()])


def test_vocabulary_allows_batched_merges(codec, reference_bpe):
    """Each token's bytes merge into that token alone: what the long form of the query rests on."""
    words = [reference_bpe.decode_single_token_bytes(i) for i in range(50256)]
    assert [int.from_bytes(x, "little") for x in codec._contract(words, bpe.SHORT_SQL)] == list(range(50256))


def test_bpe_of_a_vocabulary_that_is_not_settled():
    """Contracting all pairs of the minimum rank would give other ids here; the leftmost rule holds at every length."""
    import base64

    import tiktoken

    assert bpe.settled(bpe.ranks_of(queries.tokenizer()[0]))
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 301, b"aba": 300, b"ba": 302}
    raw = b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items())
    assert not bpe.settled(ranks)
    own, library = bpe.Codec(raw, r"\S+"), tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["abab", "ab" * 200, *("".join(rng.choice("abc") for _ in range(n)) for n in (5, 90, 97, 150, 400))]
    got = own.encode(texts)
    assert got == [np.array(library.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
    all_at_once = own._contract([b"abab"], bpe.LONG_SQL)
    assert all_at_once != got[:1]
    with pytest.raises(ValueError, match="single bytes"):
        bpe.ranks_of(b"YQ== 0")


def test_bpe_frame(spark, reference_bpe):
    docs = frame(spark, ODD * 2).withColumn("n_tokens", F.lit("extra"))
    made = bpe.round_trip(docs, *queries.tokenizer(), ids="ids_out").collect()
    assert len(made) == 2 * len(ODD) and all(bytes(r.decoded) == (r.text or "").encode() for r in made)
    assert all(bytes(r.ids_out) == np.array(reference_bpe.encode_ordinary(r.text or ""), dtype="<u4").tobytes() for r in made)
    clash = docs.withColumn("ids", F.lit("extra")).withColumn("decoded", F.lit(7))
    apart = bpe.decode(bpe.encode(clash, *queries.tokenizer()), *queries.tokenizer()).collect()
    assert sorted(bytes(r.ids) for r in bpe.round_trip(clash, *queries.tokenizer()).collect()) == sorted(bytes(r.ids_out) for r in made)
    assert sorted(bytes(r.decoded) for r in apart) == sorted(bytes(r.decoded) for r in made)
    assert bpe.round_trip(empty(spark), *queries.tokenizer()).count() == 0


# 3 licences


def test_licences(spark):
    said = dict(licences.TEMPLATES)
    texts = [f"intro words\n{t}\nmore" for t in said.values()]
    texts += ["para\n\n" + "\n".join(said["gpl-3.0-notice"].split(", ")) + "\n\nend", "Licensed under the Apache License, Version 3.0.", "released UNDER the -- MIT license!", *ODD]
    got = {r.doc_id: [(x.unit, x.licence, x.dice) for x in r.licences] for r in licences.scan(frame(spark, texts), name="licences").collect()}

    def brute(text):
        found = []
        norm = re.sub(r"[^\n0-9a-z\x80-\U0010FFFF]+", " ", (text or "").lower())
        units = [(i, x) for i, x in enumerate(norm.split("\n"))]
        units += [(-1 - i, re.sub(" ?\n ?", " ", x)) for i, x in enumerate(re.split("\n ?(?:\n ?)+", norm)) if "\n" in x]
        for i, x in units:
            w = x.strip(" ").split(" ")
            g = set(zip(w, w[1:], strict=False))
            scores = [(-2 * len(g & b) / (len(g) + len(b)), n) for n, t in sorted(licences.TEMPLATES) if (b := {tuple(y.split(" ")) for y in licences.bigrams(t)})]
            best = min(scores)
            if g and best[0] <= -0.8:
                found.append((i, best[1], round(-best[0], 6)))
        return sorted(found)

    for i, t in enumerate(texts):
        assert sorted(got[i]) == brute(t), t
    for i, name in enumerate(said):
        assert any(x[1] == name and x[2] == 1.0 for x in got[i])
    assert licences.scan(empty(spark)).count() == 0
    assert licences.scan(frame(spark, ["x"]), templates=()).first().licences == []


def brute_notices(text):
    split = lambda t: re.sub(r"[^0-9a-z\x80-\U0010FFFF]+", " ", (t or "").lower()).split()
    w, found = split(text), []
    for n, t in licences.NOTICES:
        v = split(t)
        b = set(zip(v, v[1:], strict=False))
        for i in range(len(w) - 1):
            for j in range(i + 2, min(len(w), i + 1 + max(int(1.5 * len(b)), len(v) - 1)) + 1):
                a = set(zip(w[i:j], w[i + 1 : j], strict=False))
                less = -2 * len(a & b) / (len(a) + len(b))
                if less <= -0.8:
                    found.append((less, -len(b), n, j - i, i, j))
    kept = []
    for x in sorted(found):
        if all(x[5] <= k[4] or k[5] <= x[4] for k in kept):
            kept.append(x)
    return sorted((i, j, n, round(-less, 6)) for less, _, n, _, i, j in kept)


def test_licence_windows(spark):
    whole = licences.NOTICES[-1][1]
    texts = ["Copyright 2019 Acme Inc. All rights reserved.", "The code is released under the MIT License, see the file LICENSE.", f"MIT License. {whole} The above", textwrap.fill(f"intro {whole}", 78)]
    texts += [f"some prose before it {t} and after, of the software" for _, t in licences.NOTICES]
    texts += ["All rights reserved, all rights reserved all rights. Licensed under the MIT License. Released under\nthe MIT License", "Licensed under the Apache License, Version 3.0.", *ODD]
    got = {r.doc_id: [tuple(x) for x in r.notices] for r in licences.notices(frame(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_notices(t), t
    assert [[x[2:] for x in got[i]] for i in range(4)] == [[("all-rights-reserved", 1.0)], [("mit", 1.0)], [("mit-grant", 1.0)], [("mit-grant", 1.0)]]
    assert got[2][0][:2] == (2, 69)  # the whole sentence
    assert licences.notices(empty(spark)).count() == 0
    assert licences.notices(frame(spark, ["x"]), templates=()).first().notices == []


# 4 chat


def test_chat(spark):
    rng = random.Random(4)
    bits = ["\\", "###", "</turn>", " </turn>\n", "### user: ", "0", "1", "2", "3", "a", "\n", ":", "é", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "we:ird", "a\\3", None, "", "### x"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (5, 1, "user", "tie"), (5, 1, "user", "tie")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("extra"))
    found = {r.conv_id: r for r in chat.formatted(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        got = found[conv]
        assert [(t.role, t.text) for t in got.turns] == [(r, x) for _, _, r, x in own]
        shown = [got.formatted[s.start : s.start + s.chars] for s in got.spans]
        for code, plain in (("\\2", "</turn>"), ("\\1", "###"), ("\\0", "\\")):
            shown = [x.replace(code, plain) for x in shown]
        assert shown == [x for _, _, r, x in own if r == "assistant"]
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_loss_is_cut_by_the_mask(spark):
    rng = random.Random(14)
    bits = ["\\", "###", "</turn>", "\n", "é", "😀", "plain words ", "x" * 900]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for c in range(8) for t in range(12)]
    rows += [(9, 0, "assistant", "x" * n) for n in (4096, 8170, 1)] + [(10, 0, "user", "x"), (11, 0, "assistant", "")]
    made = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).localCheckpoint()
    for r in chat.masked(made).collect():
        assert r.learnt == "".join(x for _, _, role, x in sorted(x for x in rows if x[0] == r.conv_id) if role == "assistant")
    off = made.withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["chars"].alias("chars"))))
    shown = {r.conv_id: r for r in chat.masked(off).collect()}
    assert shown[9].learnt != "x" * (4096 + 8170 + 1) and shown[9].learnt.startswith(" ")  # a wrong mask shows


# 5 decontamination


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(10, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_decontamination(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "STRASSE", "K"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (51, "!!"), (52, "same same"), (53, "same same")]
    texts = [*ODD, "same, SAME same"]
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            t[5:5] = rng.choice(items[:12])[1].upper().split()[rng.randint(0, 3) :]
        texts.append(", ".join(t))
    docs = frame(spark, texts + texts[:3], extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, bench).collect()}
    for i, t in enumerate(texts + texts[:3]):
        r = got[i]
        assert (r.n_words, sum(s.end - s.at for s in r.spans), r["items"]) == brute_hits(t, items), t
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts + texts[:3]) if not brute_hits(t, items)[1]}
    again = docs.unionByName(docs)
    assert decontaminate.hits(again, bench).count() == 2 * docs.count()
    assert decontaminate.hits(empty(spark), bench).count() == 0
    assert decontaminate.hits(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_decontamination_greek_sigma(spark):
    items = [(1, "ΛΟΓΟΣ ΑΒΓ"), (2, " ".join(f"ΛΟΓΟΣ w{i}" for i in range(6)))]
    texts = ["x ΛΟΓΟΣ.ΑΒΓ y", ".".join(f"ΛΟΓΟΣ.w{i}" for i in range(6)), "λογος αβγ", "ΛΟΓΟΣ ΑΒΓ"]
    got = {r.doc_id: r for r in decontaminate.hits(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, sum(s.end - s.at for s in got[i].spans), got[i]["items"]) == brute_hits(t, items), t
    assert [got[i]["items"] for i in range(4)] == [["1"], ["2"], [], ["1"]]


def test_decontamination_beyond_the_broadcast_bound(spark):
    """Joins by shuffle with salts give the same, with a passage that most documents share and documents without fingerprints."""
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(14))
    items = [(1, common), (2, "lone word"), (3, " ".join(f"d{i}" for i in range(30))), (4, None)]
    texts = [*ODD, *(f"x{i} {common} y{i}" if i % 3 else " ".join(f"d{j + i % 9}" for j in range(21)) for i in range(60)), "a lone word here", "few"]
    docs = frame(spark, [*texts, *texts[:5]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.hits(docs, bench, bound=0).collect():
        t = [*texts, *texts[:5]][r.doc_id]
        assert (r.n_words, sum(s.end - s.at for s in r.spans), r["items"]) == brute_hits(t, items), t
    assert decontaminate.hits(docs, bench, bound=0).count() == docs.count()
    dirty = {i for i, t in enumerate([*texts, *texts[:5]]) if brute_hits(t, items)[1]}
    for bound in (0, decontaminate.BROADCAST_ROWS):
        kept = decontaminate.clean(docs, bench, bound=bound)
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - dirty and kept.columns == docs.columns


def test_decontamination_beyond_the_bytes_of_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOW_BYTES", 100)
    items = [(1, " ".join("long" * 9 + str(i) for i in range(12)))]
    texts = [items[0][1], "clean text of some other words", "a " + items[0][1] + " b"]
    found = decontaminate.hits(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in found.collect() if r.spans} == {0, 2}
    assert "salt" in found._jdf.queryExecution().sparkPlan().toString()  # joined by shuffle


def test_quality_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = frame(spark, [" ".join(f"w{i % 7 + j}" for j in range(60 + i % 30)) for i in range(80)])
    want = {r.doc_id for r in rules.keep(docs, labels(spark, 80)).collect()}
    monkeypatch.setattr(rules, "BROADCAST_IDS", 0)
    assert {r.doc_id for r in rules.keep(docs, labels(spark, 80)).collect()} == want and want


# 6 toxicity


def test_toxicity_scores_equal_a_direct_noisy_or():
    """Sentence by sentence from the weights, and the fitted weights are a stationary point of the penalised likelihood."""
    rng = random.Random(14)
    texts = [". ".join(" ".join(rng.choice(["plain", "words", "here", "stand", "among", "others"]) for _ in range(6)) + (" vileness" if i % 4 == 0 and s == 1 else "") for s in range(4)) for i in range(160)]
    toxic = [i % 4 == 0 for i in range(160)]
    model = toxicity.train(texts, toxic, rounds=3000)
    assert model.weights

    def direct(text, weights, bias):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", text):
            if sentence and not sentence.isspace():
                found = set(re.findall(r"[0-9a-z]+", sentence.lower()))
                z = bias + sum(weights.get(f, 0.0) for w in found for f in {w.encode() + b"$", *(w.encode()[:k] for k in range(4, 9) if len(w) >= k)})
                clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    for t in texts[:20] + ["", "vileness", "vileness! Vileness\nand more", "no such thing"]:
        assert model.score(t) == pytest.approx(direct(t, model.weights, model.bias), abs=1e-9)

    def loss(weights, bias):
        p = [direct(t, weights, bias) for t in texts]
        likely = [math.log(toxicity.NOISE + (1 - toxicity.NOISE) * x) if y else math.log(1 - x) for x, y in zip(p, toxic, strict=True)]
        return -sum(likely) / len(texts) + toxicity.RIDGE / 2 * sum(w * w for w in weights.values()) / len(texts)

    at = loss(model.weights, model.bias)
    for f in model.weights:
        for step in (-0.2, 0.2):
            assert loss(model.weights | {f: model.weights[f] + step}, model.bias) >= at - 1e-4
    assert min(loss(model.weights, model.bias + s) for s in (-0.2, 0.2)) >= at - 1e-4


def test_toxicity_fit_of_repeated_ids(spark):
    """The model does not depend on how repeated ids are dealt over tasks."""
    rows = [(i, f"plain words number {i}. " + ("foulness here. " if i % 2 else "fine here. ")) for i in range(60)]
    docs = spark.createDataFrame([*rows, *((i, t + "again foulness") for i, t in rows[:30])], "doc_id long, text string")
    marks = labels(spark, 60, toxic_of=lambda i: i % 2)
    models = [toxicity.fit(x, marks) for x in (docs, docs.orderBy(F.desc("text")).repartition(7))]
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias and models[0].weights
    assert not toxicity.fit(docs, marks, most_bytes=10).weights


def test_toxicity_fit_with_a_text_over_the_bound(spark):
    """A text over the bound of bytes is left out alone, whatever its place in the order of hashes."""
    rows = [(i, f"plain words number {i}. " + ("foulness here. " if i % 2 else "fine here. ")) for i in range(60)]
    marks = labels(spark, 60, toxic_of=lambda i: i % 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    toxic = [i for i in order if i % 2]
    whole = toxicity.fit(docs, marks, most_bytes=4000)
    assert whole.weights
    for long in ((toxic[0],), (toxic[-1],), (toxic[0], order[0], toxic[7])):
        made = toxicity.fit(docs.withColumn("text", F.when(F.col("doc_id").isin(*long), F.concat("text", F.lit("more foulness. " * 400))).otherwise(F.col("text"))), marks, most_bytes=4000)
        assert made.weights and made.score("foulness here.") > 0.5 > made.score("fine here.")


def test_toxicity(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(f"word{rng.randint(0, 300)}" for _ in range(n)) + "."
    texts = [" ".join(plain(12) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for i in range(0, 300, 4):
        texts[i] += f" You nasty{rng.choice(['', 'ly', 'er'])} thing. " + plain(5)
    docs = frame(spark, texts + ODD, extra=True)
    model = toxicity.fit(docs, labels(spark, 200, toxic_of=lambda i: int(i % 4 == 0)))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(200, 300))
    for i in range(200, 300, 4):
        assert ["nasty" in texts[i][s.start : s.end] for s in got[i].sentences] == [True]
    assert got[300].score == got[301].score == got[302].score == 0
    assert toxicity.fit(docs, labels(spark, 0)).score("anything") == 0
    assert toxicity.score(empty(spark), model).count() == 0


# 7 n-gram Jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    texts = list(ODD) + [x.upper() if x else x for x in ODD]
    for _ in range(25):  # families of edited copies around the threshold, with a common passage
        base = [word() for _ in range(rng.randint(4, 120))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    rng.shuffle(texts)
    got = {r.doc_id: r for r in jaccard.linked(frame(spark, texts, extra=True)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == brute_components(texts)
    kept = {r.doc_id for r in jaccard.first_of_each(frame(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts)) if c == i}
    again = frame(spark, texts[:20])
    assert sorted(r.doc_id for r in jaccard.first_of_each(again.unionByName(again)).collect()) == sorted(r.doc_id for r in jaccard.first_of_each(again).collect())


def test_jaccard_at_every_bound(spark, monkeypatch):
    """Joins by shuffle, salted ids and split lists give the components of brute force, with lists longer than a block."""
    rng = random.Random(21)
    notice = " ".join(f"n{i}" for i in range(30))
    body = [" ".join(f"b{i}" for i in range(k, k + 12)) for k in range(6)]
    texts = [f"{rng.choice(body)} {notice} t{rng.randint(0, 40)}" for _ in range(150)] + [f"{notice} {' '.join(f'x{rng.randint(0, 9)}' for _ in range(rng.randint(1, 14)))}" for _ in range(60)]
    want = {i: c for i, (_, c) in enumerate(brute_components(texts))}
    assert 1 < len(set(want.values())) < len(texts)
    docs = frame(spark, texts)
    monkeypatch.setattr(jaccard, "FOLLOWERS", 4)
    for bound, list_rows in ((0, 8), (jaccard.BROADCAST_ROWS, 8), (0, jaccard.LIST)):
        assert {r.doc_id: r.component_id for r in jaccard.linked(docs, bound=bound, list_rows=list_rows).collect()} == want, (bound, list_rows)
    assert {r.doc_id for r in jaccard.first_of_each(docs, bound=0).collect()} == set(want.values())
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    assert {r.doc_id: r.component_id for r in jaccard.linked(docs).collect()} == want


def test_pairs_of_a_list_are_passed_on_in_parts(monkeypatch):
    """What a task holds of a list's pairs is bounded, and no pair is lost."""
    monkeypatch.setattr(jaccard, "PAIRS", 100)
    n = 300
    columns = [np.zeros(n, dtype=np.int64), np.full(n, jaccard.WHOLE), np.full(n, 50, dtype=np.int32), np.zeros(n, dtype=np.int32), np.arange(n), np.arange(n)]

    class Entries:
        def __getattr__(self, name):
            return lambda *args, **options: self

        def mapInArrow(self, over, shape):
            parts = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 90]) for c in columns], names=list("abcdef")) for i in range(0, n, 90)]
            self.made = list(over(iter(parts)))
            return self

    entries = Entries()
    jaccard._candidates(entries, jaccard.PERCENT)
    assert max(b.num_rows for b in entries.made) < 100 + n
    pairs = {p for b in entries.made for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert pairs == {(i, j) for j in range(n) for i in range(j)}


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.linked(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.linked(rows).collect()) == [(-1, None), (2, 2), (3, 2)]


def test_parity_bounds():
    rng = np.random.default_rng(0)
    for n in (1, 30, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.7)], rng.integers(0, 2**63, n // 2 + 1).astype(np.uint64)]))
        p, q = jaccard._parity(a), jaccard._parity(b)
        width = min(len(p), len(q))
        apart = (jaccard._fold(p, width) ^ jaccard._fold(q, width)).bit_count()
        assert apart <= len(a) + len(b) - 2 * shingles.shared(a, b)


# 8 secrets


def brute_base(text):
    text, found = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text, re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(6)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts = list(ODD)
    for _ in range(150):
        parts = ["plain prose words here", f'Token = "{key(rng.choice([8, 12, 40]), "0123456789abcdef")}"', f"AKIA{key(rng.choice([5, 14, 16]), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}", "é" * 3, "API_KEY: x=secret=" + key(14, "abcXYZ019+/="), "password='", "deadbeefdeadbeef"]
        texts.append(" ".join(rng.sample(parts, 4)))
    bare = "AKIB" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    docs = frame(spark, [*texts, f"see {bare} there", "Verwaltungsgemeinschaft international-cooperation"], extra=True)
    automata = secretscan.fit(docs)
    got = {r.doc_id: [(s.start, secretscan.KINDS.index(s.kind), s.end) for s in r["__spans"]] for r in secretscan.scan(docs, automata).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == brute_base(t)
    assert got[len(texts)] == [(4, 3, 4 + len(bare))] and got[len(texts) + 1] == []
    clean = {r.doc_id: r for r in secretscan.redact(docs, automata).collect()}
    assert clean[len(texts)].text == "see [SECRET] there" and clean[len(texts)].n_chars == len("see [SECRET] there")
    assert all(not brute_base(r.text) for r in clean.values()) and clean[0].text is None
    twin = secretscan.scan(docs.withColumn("__spans", F.lit("extra")), automata)
    assert twin.columns.count("__spans") == 1 and {r.doc_id: len(r["__spans"]) for r in twin.collect()} == {k: len(v) for k, v in got.items()}
    assert secretscan.fit(empty(spark)) == [] and secretscan.scan(empty(spark), []).count() == 0


def test_secret_parts_and_letters():
    rng = random.Random(11)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    automaton = secretscan.infer(["zq-" + key(20) for _ in range(400)])
    automaton.cutoff = -3.0
    dotted = secretscan.infer([f"{rng.randint(10000, 99999)}.{rng.randint(1000000, 9999999)}" for _ in range(300)])
    dotted.cutoff = -3.0
    letters, mixed = "zq-" + "kTbVwLpXsQmRnZyJdHgC", "zq-" + "k7bV2LpXs9mRnZyJd4gC"
    for secret in (letters, mixed):
        for before, after in (("", ""), ("auth=", ""), ("host/path/", ""), ("a.b.c=", "/more.txt"), ("x:", "."), (" ", "=")):
            text = f"é see {before}{secret}{after} there"
            at = text.index(secret)
            assert secretscan.spans(text, [automaton]) == [(at, 3, at + len(secret))], text
    assert secretscan.spans("v=12345.1234567.", [dotted]) == [(2, 3, 15)]
    assert secretscan.spans("Verwaltungsgemeinschaft/international.cooperation", [automaton, dotted]) == []
    assert secretscan.spans(f"{'0' * 16}/{letters}", [automaton]) == [(0, 2, 16), (17, 3, 40)]

    def brute(text):
        base = brute_base(text)
        found = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            cuts = [i for i in range(m.start(), m.end()) if text[i] in "=/."]
            for s in (m.start(), *(i + 1 for i in cuts)):
                for e in (*cuts, m.end()):
                    if e - s >= 12 and not any(a < e and s < b for a, _, b in base) and any(x.score(text[s:e]) >= x.cutoff for x in (automaton, dotted)):
                        found.append((s, 3, e))
        return sorted(base + [x for x in found if not any(y != x and y[0] <= x[0] and x[2] <= y[2] for y in found)])

    for _ in range(300):
        parts = [letters, mixed, "=", "/", ".", "12345.1234567", "token=", "0123456789abcdef", " ", "word", "zq-"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert secretscan.spans(text, [automaton, dotted]) == brute(text), text


def test_long_candidates_are_scored_whole(monkeypatch):
    rng = random.Random(8)
    automata = [secretscan.infer(["".join(rng.choice("abcdef0123456789") for _ in range(rng.randint(8, 60))) + ".zq=" * rng.randint(0, 3) for _ in range(400)]), secretscan.infer([".".join(str(rng.randint(10, 99999)) for _ in range(rng.randint(2, 9))) for _ in range(300)])]
    plain = secretscan.background(["international.cooperation", "Haus/Garten", "WORDS"])
    for automaton in automata:
        automaton.plain, automaton.cutoff = plain, 0.0

    def brute(text):
        base = brute_base(text)
        found = set()
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            cuts = [i for i in range(m.start(), m.end()) if text[i] in "=/."]
            for s in (m.start(), *(i + 1 for i in cuts)):
                for e in (*cuts, m.end()):
                    if e - s >= 12 and not any(a < e and s < b for a, _, b in base) and any(x.score(text[s:e]) >= x.cutoff for x in automata):
                        found.add((s, 3, e))
        return sorted(base + [x for x in found if not any(y != x and y[0] <= x[0] and x[2] <= y[2] for y in found)])

    digits = ".".join(str(rng.randint(10, 99999)) for _ in range(400))
    assert len(digits) > 2 * secretscan.SCORED and (0, 3, len(digits)) in secretscan.spans(digits, automata)  # one candidate, longer than any scored by itself
    monkeypatch.setattr(secretscan, "SCORED", 24)
    seen = 0
    for _ in range(200):
        text = "".join(rng.choice(["1234", ".", ".", "90.", "17.", "55081", "abc.", "zq=", "/", " ", "token=", "W", "0123456789abcdef"]) for _ in range(rng.randint(10, 60)))
        got = secretscan.spans(text, automata)
        assert got == brute(text), text
        seen += any(k == 3 and e - s > 24 for s, k, e in got)
    assert seen > 5


def test_automaton_scores_equal_brute_force():
    """Likelihoods by walking explicit probability tables, and the ratio to plain words by counting."""
    rng = random.Random(12)
    words = ["k-" + "".join(rng.choice("0123456789abcxyz") for _ in range(rng.choice([12, 20]))) for _ in range(120)]
    plain = ["unterhaltungsprogramm", "international-cooperation", "Verwaltungsgemeinschaft", "configuration.directory"]
    automaton = secretscan.infer(words)
    automaton.plain = secretscan.background(plain)
    kind = lambda c: "D" if c.isdigit() else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if c.islower() else "U" if c.isupper() else c
    steps = Counter((a, b) for w in plain for a, b in zip(["", *map(kind, w)], [*map(kind, w), ""], strict=True))
    for word in [*words[:20], *plain, "k-12", ""]:
        state, mine, theirs, before = 0, 1.0, 1.0, ""
        for c in [*map(kind, word), ""]:
            total = sum(n for (a, _), n in steps.items() if a == before)
            theirs *= 0.1 / 12 + 0.9 * (steps[before, c] / total if total else 1 / 12)
            before = c
            if c == "":
                mine *= math.exp(automaton.stops[state])
            elif c in automaton.steps[state]:
                state, p = automaton.steps[state][c][0], math.exp(automaton.steps[state][c][1])
                mine *= p
            else:
                mine = 0.0
                break
        want = (math.log(mine) - math.log(theirs)) / (len(word) + 1) if mine else -math.inf
        assert automaton.score(word) == pytest.approx(want, abs=1e-9), word
    for row, stop in zip(automaton.steps, automaton.stops, strict=True):
        assert sum(math.exp(p) for _, p in row.values()) + math.exp(stop) == pytest.approx(1, abs=0.35)


def test_secrets_without_their_assigning_word(spark):
    """Recall on credentials whose assigning word was removed, and plain words and places left alone."""
    rng = random.Random(13)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    syllables = ["ver", "lich", "tion", "men", "ung", "con", "pro", "ge", "schaft", "al", "ber", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 7)))
    prose = lambda: " ".join([word() for _ in range(30)] + [f"mail{rng.randint(0, 9)}.example.com", f"{word().title()}-{word()}.", "192.168.17.254"])
    labelled = [f"{prose()} token={key()} {prose()}" for _ in range(200)]
    bare = [f"{prose()} {key()} {prose()}" for _ in range(200)]
    clean = [prose() for _ in range(200)]
    docs = frame(spark, labelled * 2 + clean)  # repeated rows
    automata = secretscan.fit(docs)
    assert all(a.recall >= 0.9 for a in automata)
    hit = sum(any(k == 3 and t[s:e] in t.split() for s, k, e in secretscan.spans(t, automata)) for t in bare)
    assert hit >= 0.9 * len(bare)
    assert sum(len(secretscan.spans(t, automata)) for t in clean) <= 0.01 * 32 * len(clean)
    long = " ".join([f"token={'ab12' * 5}/x"] * 3000) + " " + "a1.b2/" * 30000
    assert sum(k == 0 for _, k, _ in secretscan.spans(long, automata)) == 3000


def test_automaton():
    rng = random.Random(0)
    words = ["ab" + "".join(rng.choice("0123456789") for _ in range(8)) for _ in range(200)]
    automaton = secretscan.infer(words)
    assert len(automaton.steps) < 15 and automaton.score("ab12345678") > -math.inf and automaton.score("zz!") == -math.inf
    assert secretscan.infer([]) is None


# 9 token ids


def test_pack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for most in (2, 300, 70_000, 2**32):
            v = rng.integers(0, most, n)
            control, data = tokens.pack(v)
            assert len(control) == -(-n // 4) and (tokens.unpack(control, data, n) == v).all()


def test_token_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        definition = file.read()
    library = Tokenizer.from_str(definition.decode())
    marks = "".join(f"H{chr(c)}. " for c in range(0x300, 0x340))
    texts = [*ODD, "Word, WORD. é. É, …. (x). 3. <|endoftext|> A<|Endoftext|>B\x01c", marks, unicodedata.normalize("NFD", "Ébène Straße."), "it's 'll I'VE", "a.b,c. d"]
    docs = frame(spark, texts + texts[:2], extra=True).withColumn("doc_id", F.when(F.col("doc_id") < len(texts), F.col("doc_id") * 3 - 5).otherwise(F.lit(4)))
    tokens.write(docs, definition, str(tmp_path / "f"), end=2)
    got = tokens.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    seen, at = {}, 0
    for r in got:
        seen.setdefault(r.doc_id, []).append(bytes(r.ids))
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    tokens.write(empty(spark), definition, str(tmp_path / "e"), end=2)
    assert tokens.read(spark, str(tmp_path / "e")).count() == 0


def test_token_ids_query(spark, sf):
    got = queries.QUERIES["op9_token_ids"](spark, sf).orderBy("start").collect()
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r, d in zip(got, spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = np.array(library.encode(d.text, add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# Queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    mine, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(str, mine[cols].itertuples(index=False, name=None))) == sorted(map(str, theirs[cols].itertuples(index=False, name=None)))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns, name
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    order = sorted(rows)
    root = {order[i]: order[c] for i, (_, c) in enumerate(brute_components([rows[d].text for d in order]))}
    kept_rules = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {d for d in order if root[d] == d}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()} == {d for d in order if not brute_hits(rows[d].text, items)[1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) <= kept_rules and all(not brute_hits(rows[d].text, items)[1] for d in got) and len({root[d] for d in got}) == len(got)
    assert all(len(r.ids) == 4 * r.n_tokens for r in got.values())


def test_pipeline_of_odd_and_of_no_rows(spark, sf, tmp_path):
    """Null and empty texts, repeated rows, further columns, and a table without rows pass through every stage."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    long = " ".join(f"word{i}" for i in range(300))
    odd = frame(spark, [*ODD, long, long, long + " more", "x" * 3000]).withColumn("extra", F.lit("kept"))
    odd = odd.unionByName(odd)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == odd.columns and made.where("extra <> 'kept'").isEmpty(), name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, odd, str(tmp_path)), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {len(ODD)} and kept.count() == 1
    assert {r.n_tokens for r in corpus_pipeline.byte_bpe(spark, odd.where("text IS NULL OR text = ''"), str(tmp_path)).collect()} == {0}
    odd.limit(0).drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_digest_of_base_spans(spark, sf):
    for r, d in zip(queries.QUERIES["op8_secret_scans"](spark, sf).orderBy("doc_id").collect(), spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        joined = ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(d.text))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()

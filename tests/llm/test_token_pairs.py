"""The automaton and the alignment of tokenizers against their libraries and brute force."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from gradus.llm import alignment, automaton, queries  # noqa: E402

ODD = [
    None, "", " ", "\n\t ", "a", " a", "Hello, world's  end!", "<|endoftext|>", "a<|startoftext|><|endoftext|>b <|ENDOFTEXT|>", "x" * 3000, "ab" * 700,
    "été İstanbul ΟΣ é ﬁ 日本語 \U0001f600\U0001f600", "▁a▁b", "a\x00b\x1c\x85c\xa0d", "<0x41> <unk> <s></s>", "1234567890" * 20, "a\r\nb c",
    "same text of some words", "same text of some words", "they're we'll I'VE '''s", "абв Γειά สวัส", "=-=-=-" * 300,
]


def definition(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def frame(spark, texts, *names):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in names:
        made = made.withColumn(x, F.lit("extra"))
    return made


def chance(seed, letters, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def machine():
    return automaton.Transducer(definition(), automaton._compiled(definition()))


# 12 the automaton


def test_automaton_encodes_as_the_library(machine):
    library = Tokenizer.from_str(definition().decode())
    texts = [x or "" for x in ODD] + chance(1, "aaabbcdeèß 01 .,<|>'sSTİΣσŒ日é\t\n\x1c\x85\xa0_-=Ω", 4000, 60)
    texts += chance(2, "aehinrst", 4000, 40) + chance(3, "at=-", 2000, 90)
    made = machine.encode(texts)
    for text, raw, known in zip(texts, made, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, dtype="<i4").tolist() == known.ids, repr(text)
    assert machine.decode(made) == [library.decode(np.frombuffer(x, dtype="<i4").tolist(), skip_special_tokens=False) for x in made]
    assert machine.encode(texts) == made  # from the memo


def test_every_character_below_the_bound_is_cut_as_by_the_library(machine):
    library = machine.library
    for c in map(chr, range(automaton.PLAIN)):
        text = f"a{c}7{c}.{c}'s{c}{c} {c}"
        own = [x.encode() for x in machine.pattern.findall(text.lower())]
        cut = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        assert own == [bytes(map(machine.bytes_of.__getitem__, x)) for x, _ in cut], repr(c)


def small(merges, letters="abc", suffix="</w>"):
    words = [*letters, *(x + suffix for x in letters if suffix), *(a + b for a, b in merges)]
    return automaton.compiled({x: i for i, x in enumerate(words)}, merges, suffix)


def accepted(machine, labels):
    state = machine.start
    for x in labels:
        i = machine.labels.index(x)
        if not machine.rows[state][machine.kind[i] >> 3] >> (machine.kind[i] & 7) & 1:
            return False
        state = machine.target[i]
    return True


def merged(word, merges):
    parts = [*word[:-1], word[-1] + "</w>"]
    while True:
        ranked = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (a, b) in merges]
        if not ranked:
            return parts
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_accepts_one_sequence_of_each_word():
    merges = [("a", "a"), ("aa", "a"), ("a", "b</w>"), ("aa", "aa"), ("b", "c"), ("bc", "bc"), ("aaa", "bc"), ("a", "bc"), ("bc", "a</w>")]
    machine = small(merges)
    for n in range(1, 8):
        for word in {"".join(x) for x in chance(n, "abc", 120, 1) + ["".join(random.Random(i + 100 * n).choice("aabbc") for _ in range(n)) for i in range(120)]}:
            if not word:
                continue
            ways = [[]]
            found = []

            def split(rest, said):
                if not rest:
                    found.append(said)
                for k in range(1, len(rest) + 1):
                    label = rest[:k] + ("</w>" if k == len(rest) else "")
                    if label in machine.labels:
                        split(rest[k:], [*said, label])

            split(word, ways[0])
            assert [x for x in found if accepted(machine, x)] == [merged(word, merges)], word


def test_automaton_refuses_what_it_cannot_compile():
    with pytest.raises(ValueError, match="new token"):
        small([("aa", "b"), ("a", "a")])
    other = json.loads(definition())
    for change in ({"decoder": {"type": "ByteLevel"}}, {"model": other["model"] | {"dropout": 0.1}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError, match="compiled"):
            automaton._definition(json.dumps(other | change).encode())


def test_automaton_without_the_plain_way_cuts_by_the_library(machine):
    other = json.loads(definition())
    other["normalizer"]["normalizers"].pop(1)
    slow = automaton.Transducer(json.dumps(other).encode(), automaton._compiled(definition()))
    texts = [x or "" for x in ODD]
    assert slow.pattern is None and slow.encode(texts) == machine.encode(texts)


def test_op12_on_odd_rows(spark):
    library = Tokenizer.from_str(definition().decode())
    given = frame(spark, ODD, "ids", "decoded", "n_tokens")
    rows = {r["doc_id"]: r for r in automaton.round_trip(given, definition()).collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (rows[i]["ids"], rows[i]["decoded"], rows[i]["n_tokens"]) == (ids, library.decode(ids, skip_special_tokens=False), "extra")
    apart = automaton.decode(automaton.encode(given.drop("decoded"), definition()), definition())
    assert {r["doc_id"]: r["decoded"] for r in apart.collect()} == {i: r["decoded"] for i, r in rows.items()}
    assert automaton.round_trip(frame(spark, ODD).where("false"), definition()).count() == 0


def test_op12_query(spark, sf):
    library = Tokenizer.from_str(definition().decode())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_bpe_automaton(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(),
        )


# 13 alignment


def brute(texts):
    """The rows of the contract, by loops over tokens."""
    first = Tokenizer.from_str(definition("byte_bpe_50k.json").decode())
    first.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = automaton.alphabet()
    words = {i: w for w, i in first.get_vocab().items()}

    def piece(i):
        said = other.id_to_piece(i)
        return bytes([int(said[3:5], 16)]) if other.is_byte(i) else said.replace("▁", " ").encode()

    linked, shape = [], []
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = other.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        bytes_a = [bytes(letters[c] for c in words[i]) for i in a]
        bytes_b = [piece(i) for i in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a = b = bytes_a = bytes_b = []

        def spans(tokens):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            return out

        of_a, of_b = spans(bytes_a), spans(bytes_b)
        own, k = [], 0
        for i, (s, e) in enumerate(of_a):
            while k < len(of_b) and of_b[k][1] <= s:
                k += 1
            j = k
            while j < len(of_b) and of_b[j][0] < e:
                own.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in of_a} & {e for _, e in of_b})
        groups, before = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, (_, e) in zip(a, of_a, strict=True) if before < e <= end) + "|" + ",".join(str(i) for i, (_, e) in zip(b, of_b, strict=True) if before < e <= end))
            before = end
        linked.append(own)
        shape.append((len(a), len(b), len(ends), len(own), ";".join(groups)))
    count = Counter(x for own in linked for x in set(own))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(*s[:4], sum(count[x] == best[x[0]] for x in own), sum(count[x] for x in own), s[4]) for own, s in zip(linked, shape, strict=True)]


def files():
    return definition("byte_bpe_50k.json"), definition("piece_bpe_32k.model")


def test_parts_are_encoded_as_whole_texts(monkeypatch):
    """By the memo of parts, in a second round, and without parts, the ids are those of both libraries on whole texts."""
    own = alignment.Pair(*files())
    assert own.parts
    texts = ODD + [f"a{chr(c)}7{chr(c)}.{chr(c)}'s{chr(c)}{chr(c)} {chr(c)} b " for c in range(0x250)]
    texts += chance(4, "ab 's\n\t\x85\xa01.éΩ▁<s>", 3000, 40) + chance(5, "a  \n", 1500, 12) + [" lead", "  lead", "trail ", "a" * 60 + " b", "\n \n x"]
    first, second = own.encode(texts), own.encode(texts)
    whole = [own._whole(x) if x else (b"", b"") for x in texts]
    assert first == second == tuple(map(list, zip(*whole, strict=True)))
    own.parts = False
    own.new, own.old = {}, {}
    assert own.encode(texts) == first
    monkeypatch.setattr(alignment, "MEMO", 50)
    own.parts = True
    made = [own.encode(texts[i : i + 40]) for i in range(0, len(texts), 40)]
    assert [x for a, _ in made for x in a] == first[0] and [x for _, b in made for x in b] == first[1]


def test_op13_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ROWS", 50)
    texts = ODD + chance(5, "aehinrst  \n.,é日▁", 120, 80) + ["hot words of many rows"] * 150
    expected = brute(texts)
    made = alignment.align(frame(spark, texts, "n_a", "groups", "key", "n", "__a").repartition(7), *files())
    rows = {r["doc_id"]: r for r in made.collect()}
    assert len(rows) == len(texts) and rows[3]["key"] == "extra" and "text" not in made.columns
    for i, known in enumerate(expected):
        r = rows[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == known, repr(texts[i])
    assert expected[12][:4] == (0, 0, 0, 0)  # its U+2581 comes back as a space


def test_op13_empty(spark):
    assert alignment.align(frame(spark, ODD).where("false"), *files()).count() == 0
    only = alignment.align(frame(spark, [None, ""]), *files()).collect()
    assert [(r["n_a"], r["count_sum"], r["groups"]) for r in only] == [(0, 0, "")] * 2


def test_partial_counts_are_passed_on_in_bounded_parts(spark, monkeypatch):
    for name, value in (("WAITING", 3), ("HELD", 5), ("ROWS", 2)):
        monkeypatch.setattr(alignment, name, value)
    key, count = alignment.merged([np.array([5, 1, 5]), np.array([1])], [np.array([1, 2, 3]), np.array([10])])
    assert key.tolist() == [1, 5] and count.tolist() == [12, 4]
    texts = ["one two three", "one two four", "two one three", None] * 5
    pieces = alignment.pieces_of(*files())
    lengths = [np.array([len(x) for x in p]) for p in pieces]

    class Given:
        value = (*lengths, *map(alignment._kind, pieces), None)

    seen = {}

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, over, shape):
            own = alignment.Pair(*files())
            a, b = own.encode(texts)
            batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 2], pa.binary()), pa.array(b[i : i + 2], pa.binary())], names=["__a", "__b"]) for i in range(0, 20, 2)]
            for batch in over(iter(batches)):
                assert batch.num_rows <= 2
                for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen[k] = seen.get(k, 0) + n

    alignment._partial(Rows(), Given())
    known = Counter()
    for text in texts[:3]:
        a, b = alignment.Pair(*files()).encode([text])
        made = alignment.links(np.frombuffer(a[0], "<u2").astype(int), np.frombuffer(b[0], "<u2").astype(int), np.array([len(a[0]) // 2]), np.array([len(b[0]) // 2]), *lengths)
        known.update({int(x): 5 for x in set((made.a << 32 | made.b).tolist())})
    assert seen == dict(known)


def test_op13_query(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = dict(zip([i for i, _ in texts], brute([t for _, t in texts]), strict=True))
    rows = queries.op13_token_alignment(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = known[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == n[:6]
        assert r["groups_sha256"] == (hashlib.sha256(n[6].encode()).hexdigest() if n[6] else "")

"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

Compiling. The automaton of no merges accepts every sequence of single symbols: one state inside a word, one after its
last symbol. The merges are then worked in by rank, each by one gadget: for (u, v) -> uv, the arcs labelled u lead to a
copy of their state that has no arc v, and every state with an arc u gets an arc uv to where v leads. All arcs of one
label lead to one state, so the automaton is a row of arcs for each state and one target for each label. Rows are copied
only when a merge tells their labels apart, and so are columns: labels that no merge has told apart share a class of
arcs. What comes out accepts the token sequences of correct encodings alone, one for each word.

Encoding. Every prefix of a correct encoding is the correct encoding of its text. So one pass over a word, stepping
through the trie of arc labels from each place and asking the table whether the state there has that arc, sets the one
arc that enters each place; the arcs are then read back from the end. The cost is linear in the word's length, for long
words too. Words repeat, so a bounded memo stands before the automaton.

Decoding emits the labels of the arcs, joined by one space (a tokenizer that has no decoder of its own joins them so).

The definition is that of the tokenizers library: its normaliser and pre-tokeniser cut texts into words (texts whose
characters all lie below U+0300 by the same pattern here, which is quicker), added tokens are matched literally.

Defined results: null and empty texts have no ids and decode to an empty text; equal texts get equal ids; an empty table
gives an empty result; further columns pass through, but a column that has the name of a result is replaced. A
vocabulary in which a merge makes a token that already exists, or uses one that does not, is refused, as are added
tokens that strip blanks, match whole words only or are normalised, dropout, unknown tokens and a decoder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import kept, ready

#: Words of one generation of the memo (two are held), and the most characters of a word that is remembered.
MEMO, REMEMBERED = 150_000, 48
#: Characters of text that are worked on at once.
CHUNK = 1_000_000
#: Characters from here on may compose or change case by their neighbours; texts that have some are cut by the library.
PLAIN = 0x300
BEYOND = regex.compile(f"[^\\x00-{chr(PLAIN - 1)}]")


def alphabet() -> dict[str, int]:
    """The byte of each character of byte-level tokens: printable bytes stand for themselves, the others are moved up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Automaton:
    """``labels`` by id; ``target`` the state that a label's arcs lead to; ``kind`` the class of a label's arcs; ``rows`` a bit a class for each state."""

    labels: list[str]
    target: np.ndarray
    kind: np.ndarray
    rows: np.ndarray
    start: int


def _grown(arcs: np.ndarray, axis: int) -> np.ndarray:
    return np.concatenate([arcs, np.zeros_like(arcs)], axis=axis)


def compiled(vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Automaton:
    """The automaton of a vocabulary: the gadgets of all merges, one after another."""
    labels = sorted(vocabulary, key=vocabulary.__getitem__)
    if [vocabulary[x] for x in labels] != list(range(len(labels))):
        raise ValueError("ids must be 0, 1, 2, ...")
    made = {a + b for a, b in merges}
    arcs = np.zeros((1024, 1024), dtype=bool)
    inside, end = 0, 1
    arcs[inside, 0] = True
    target, kind = np.full(len(labels), -1, dtype=np.int32), np.full(len(labels), -1, dtype=np.int32)
    for i, x in enumerate(labels):
        if x not in made:
            target[i], kind[i] = (end if suffix and x.endswith(suffix) else inside), 0
    # labels that share a state or a class; the start of a word counts too
    sharing = [1 + int((target == inside).sum()), int((target == end).sum())]
    alike = [int((kind == 0).sum())]
    for first, second in merges:
        u, v, w = vocabulary[first], vocabulary[second], vocabulary.get(first + second, -1)
        if w < 0 or target[w] >= 0 or target[u] < 0 or target[v] < 0 or (suffix and target[u] == end):
            raise ValueError("a merge must make a new token of two earlier ones")
        beyond = target[v]
        if u == v or sharing[target[u]] > 1:
            arcs = _grown(arcs, 0) if len(sharing) == len(arcs) else arcs
            arcs[len(sharing)] = arcs[target[u]]
            sharing[target[u]] -= 1
            target[u] = len(sharing)
            sharing.append(1)
        if alike[kind[v]] > 1:
            arcs = _grown(arcs, 1) if len(alike) == arcs.shape[1] else arcs
            arcs[:, len(alike)] = arcs[:, kind[v]]
            alike[kind[v]] -= 1
            kind[v] = len(alike)
            alike.append(1)
        arcs[target[u], kind[v]] = False
        target[w], kind[w] = beyond, kind[u]
        sharing[beyond] += 1
        alike[kind[w]] += 1
    rows = np.packbits(arcs[: len(sharing), : len(alike)], axis=1, bitorder="little")
    return Automaton(labels, target, kind, rows, inside)


def _definition(text: bytes) -> tuple[dict, str | None]:
    """The parts of a tokenizer's definition, and the pattern of its words where plain texts can be cut here."""
    whole = json.loads(text)
    model = whole["model"]
    refused = model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback")
    strange = any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in whole["added_tokens"])
    if refused or model.get("ignore_merges") or strange or whole["decoder"] or whole["post_processor"]:
        raise ValueError("only plain byte-level byte-pair encodings are compiled")
    normal, before = whole["normalizer"], whole["pre_tokenizer"]
    if not before or not json.dumps(before).count('"ByteLevel"'):
        raise ValueError("only byte-level tokenizers are compiled")
    steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    cuts = parts[0] if [x["type"] for x in parts] == ["Split", "ByteLevel"] else {}
    plain = (
        steps == ["NFC", "Replace", "Lowercase"]
        and (normal["normalizers"][1]["pattern"], normal["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (cuts.get("behavior"), cuts.get("invert")) == ("Removed", True)
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
    )
    return whole, cuts["pattern"]["Regex"] if plain else None


@lru_cache(maxsize=2)
def _compiled(definition: bytes) -> Automaton:
    model = _definition(definition)[0]["model"]
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return compiled(model["vocab"], pairs, model.get("end_of_word_suffix") or "")


class Transducer:
    """Words to ids and ids to labels, by the tables of an automaton; with the memo of one worker."""

    def __init__(self, definition: bytes, machine: Automaton) -> None:
        whole, pattern = _definition(definition)
        self.library = Tokenizer.from_str(definition.decode())
        self.pattern = regex.compile(pattern) if pattern else None
        self.bytes_of = alphabet()
        self.target, self.kind = machine.target.tolist(), machine.kind.tolist()
        self.rows = [x.tobytes() for x in machine.rows]
        self.start = machine.start
        suffix = whole["model"].get("end_of_word_suffix") or ""
        self.mark = 256 if suffix else 0
        #: The trie of labels: (node << 9 | symbol) to the next node, and the label that ends at a node.
        self.steps: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i, label in enumerate(machine.labels):
            last = bool(suffix) and label.endswith(suffix)
            symbols = [self.bytes_of[c] for c in (label[: -len(suffix)] if last else label)]
            if last:
                symbols[-1] |= 256
            node = 0
            for s in symbols:
                key = node << 9 | s
                if key not in self.steps:
                    self.steps[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.steps[key]
            self.ends[node] = i
        added = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.added = {x: np.array([i], dtype="<i4").tobytes() for x, i in added.items()}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.labels = {**dict(enumerate(machine.labels)), **{i: x for x, i in added.items()}}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, raw: bytes) -> list[int]:
        """The ids of one word: each place is entered by the one arc that the state before it has."""
        n, mark, steps, ends, rows, kind = len(raw), self.mark, self.steps, self.ends, self.rows, self.kind
        symbols = list(raw)
        if n:
            symbols[-1] |= mark
        entered = [-1] * (n + 1)
        lengths = [0] * (n + 1)
        for at in range(n):
            row = rows[self.target[entered[at]] if at else self.start]
            node, to = 0, at
            while to < n:
                node = steps.get(node << 9 | symbols[to])
                if node is None:
                    break
                to += 1
                label = ends[node]
                if label >= 0 and row[kind[label] >> 3] >> (kind[label] & 7) & 1:
                    entered[to], lengths[to] = label, to - at
        ids = []
        while n:
            ids.append(entered[n])
            n -= lengths[n]
        return ids[::-1]

    def _words(self, text: str) -> list[str]:
        if self.pattern and (text.isascii() or not BEYOND.search(text)):
            return self.pattern.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text) if self.library.normalizer else text)
        return [bytes(map(self.bytes_of.__getitem__, x)).decode() for x, _ in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        cut: list[list[str | bytes]] = []
        for text in texts:
            if self.cuts and self.cuts.search(text):
                cut.append([y for i, x in enumerate(self.cuts.split(text)) for y in ([self.added[x]] if i % 2 else self._words(x))])
            else:
                cut.append(self._words(text))
        new, old, once = self.new, self.old, {}
        for x in set().union(*cut):
            if x not in new:
                if isinstance(x, bytes):  # an added token stands for itself
                    once[x] = x
                elif x in old:
                    new[x] = old[x]
                else:
                    (new if len(x) <= REMEMBERED else once)[x] = np.array(self.word(x.encode()), dtype="<i4").tobytes()
        look = new.__getitem__ if not once else lambda x: new[x] if x in new else once[x]
        return [b"".join(map(look, x)) for x in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        return [" ".join(map(self.labels.__getitem__, np.frombuffer(x, dtype="<i4").tolist())) for x in ids]


def _chunks(texts: list[str]) -> Iterator[slice]:
    start = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += len(x)
    yield slice(start, len(texts))


def _listed(rows: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def _mapped(docs: DataFrame, definition: bytes, source: str, outputs: dict[str, T.DataType], work) -> DataFrame:
    spark = ready(docs.sparkSession)
    if source in outputs:
        raise ValueError(f"the result needs another name than {source}")
    docs = docs.drop(*outputs)
    given = spark.sparkContext.broadcast((definition, _compiled(definition)))  # some 10 MB, by the vocabulary
    at, key = docs.columns.index(source), hashlib.sha256(definition).hexdigest()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"automaton {key}", lambda: Transducer(*given.value))
        for batch in batches:
            values = batch.column(at)
            if pa.types.is_list(values.type):
                values = [np.array(x or [], dtype="<i4").tobytes() for x in values.to_pylist()]
            else:
                values = [x or "" for x in values.to_pylist()]
            for part in _chunks(values):
                through = batch.slice(part.start, part.stop - part.start).columns
                yield pa.RecordBatch.from_arrays([*through, *work(own, values[part])], names=[*batch.schema.names, *outputs])

    return docs.mapInArrow(over, T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in outputs.items())]))


def encode(docs: DataFrame, definition: bytes, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text, an array of integers."""
    return _mapped(docs, definition, text, {ids: T.ArrayType(T.IntegerType())}, lambda own, x: [_listed(own.encode(x))])


def decode(encoded: DataFrame, definition: bytes, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the labels of each row's ids, joined by spaces; an id that the tokenizer does not have is an error."""
    return _mapped(encoded, definition, ids, {decoded: T.StringType()}, lambda own, x: [pa.array(own.decode(x), pa.string())])


def round_trip(docs: DataFrame, definition: bytes, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with both columns, from one pass in one worker."""

    def work(own: Transducer, texts: list[str]) -> list[pa.Array]:
        made = own.encode(texts)
        return [_listed(made), pa.array(own.decode(made), pa.string())]

    return _mapped(docs, definition, text, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, work)

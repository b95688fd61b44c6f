"""Byte-level BPE as a tokenization automaton: merge gadgets, encoding by transitions, decoding by arc labels."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Encoded words that a task remembers, and the bytes of the longest.
REMEMBERED, LONGEST = 500_000, 64
#: White space as Unicode has it, in code points.
SPACES = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(*first: str) -> str:
    """Code points of the basic plane whose category begins with one of these letters, as ranges."""
    out, last = [], None
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] in first:
            if last is not None and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
            last = c
    return "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in out)


def word_pattern() -> str:
    """The split into words: contractions, letters, numbers and other signs with the space before them, and spaces, of which the last before a word stays with it."""
    letters, numbers = _class("L"), _class("N")
    return f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


class Automaton:
    """A deterministic automaton over tokens that accepts, for each text, its one tokenization.

    It starts as one state with an arc to itself for each byte. The merge of u and v as w takes the v arc from the state that u leads to,
    since u v is no tokenization any more, and gives every state from which u and then v led on an arc w to where v leads. All arcs of a token lead to
    the same state, so a merge makes one state: a copy, without v, of the one that u led to. Of a copy only the difference is stored
    (from which state, without which arc, since which merge), and that a state has w from a merge on says that it had u at that time: an arc is
    looked up along both chains. The tables hold a few numbers for each token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.label = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        size = max(self.label) + 1
        self.left, self.since_token, self.into = [-1] * size, [size * 2] * size, [0] * size  # a token without arcs is younger than all states
        self.parent, self.without, self.since = [-1], [-1], [-1]
        for i, t in self.label.items():
            if len(t) == 1 and i not in self.special.values():
                self.since_token[i] = -1
        for rank, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.token = {t: i for i, t in self.label.items() if self.since_token[i] < size * 2 and i not in self.special.values()}
        self.longest = max(map(len, self.token))
        self.tree: dict = {}  # byte: (what follows, the token that ends here or -1)
        self.shorter = [-1] * size  # the longest token that begins a token, itself left out
        for t, i in sorted(self.token.items()):
            node, last = self.tree, -1
            for b in t[:-1]:
                node, end = node.setdefault(b, ({}, -1))
                last = end if end >= 0 else last
            node[t[-1]] = (node.get(t[-1], ({}, -1))[0], i)
            self.shorter[i] = last
        self.arcs = _Arcs(self)

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        state = self.into[u]
        if not self.arc(state, v) or self.since_token[w] < rank:
            return
        self.left[w], self.since_token[w], self.into[w] = u, rank, self.into[v]
        self.parent.append(state)
        self.without.append(v)
        self.since.append(rank)
        self.into[u] = len(self.parent) - 1

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this token."""
        parent, without, since, born = self.parent, self.without, self.since, self.since_token
        while True:
            while since[state] > born[token]:
                if without[state] == token:
                    return False
                state = parent[state]
            if born[token] < 0:
                return True
            token = self.left[token]

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells the word: longest labels first, as far as arcs lead. All paths that reach a place from the
        start end with the same token, so a place that led nowhere is never tried again."""
        if (whole := self.token.get(word)) is not None:
            return [whole]
        n, into, arcs, label, longest, path, ends, dead, at, state = len(word), self.into, self.arcs, self.label, self.longest, [], [], set(), 0, -1
        while at < n:
            node, t = self.tree, -1
            for b in word[at : at + longest]:
                if (step := node.get(b)) is None:
                    break
                node, end = step
                if end >= 0:
                    t = end
            while True:
                while t < 0:  # nothing leads on from here
                    dead.add(at)
                    t, at = path.pop(), ends.pop()
                    t = self.shorter[t]
                    state = into[path[-1]] << 32 if path else -1
                to = at + len(label[t])
                if to not in dead and (state < 0 or arcs[state | t]):
                    break
                t = self.shorter[t]
            path.append(t)
            ends.append(at)
            at, state = to, into[t] << 32
        return path

    def decode(self, ids: list[int]) -> str:
        """The labels along the arcs, as text; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


class _Arcs(dict):
    """Arcs (state << 32 | token) that have been looked up; forgets all when full."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, key: int) -> bool:
        if len(self) >= 2 * REMEMBERED:
            self.clear()
        found = self[key] = self.automaton.arc(key >> 32, key & 0xFFFFFFFF)
        return found

    def __reduce__(self):
        return _Arcs, (self.automaton,)


class _Words(dict):
    """Words to the bytes of their ids; forgets all when full."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        ids = np.array(self.automaton.encode(data), "<u4").tobytes()
        if len(data) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids: special tokens first, then words, then the automaton."""

    def __init__(self, automaton: Automaton, pattern: str):
        self.automaton, self.words, self.split = automaton, _Words(automaton), re.compile(pattern)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None
        #: What this Python's tables of categories don't name, or what the pattern leaves out.
        known = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in _known())
        self.unknown = re.compile(f"[^{known}]")

    def pre_split(self, text: str) -> list[str]:
        """Words of a text. Outside the basic plane, and where Unicode has grown since this Python, the library's own splitter says what a letter is."""
        if text.isascii() or not self.unknown.search(text):
            return self.split.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.automaton.special:
                out.append(np.array([self.automaton.special[part]], "<u4").tobytes())
            else:
                out.extend(map(self.words.__getitem__, self.pre_split(part)))
        return b"".join(out)


def _known() -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in range(0x10000):
        if unicodedata.category(chr(c)) not in ("Cn", "Cs"):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return [(a, b) for a, b in out]


_HELD: dict = {}


def _encoder(name: str, tables) -> Encoder:
    """The worker's encoder for these tables, kept with its remembered words for later tasks."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Encoder(*tables.value)
    return _HELD[name]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ids (binary: little-endian unsigned 32-bit numbers) and decoded (string) of every whole text.

    path: a vocabulary file with byte-level BPE merges, read on the driver, where the automaton is built once; tasks get its tables, whose size is
    that of the vocabulary. Null and empty texts have no ids and an empty decoded text. Repeated rows each get their row. Texts of any length are
    encoded whole, in time that grows with their length; other columns play no part. Empty input: empty result.
    """
    fields = [docs.schema[c] for c in keep]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids binary, decoded string"])
    name = uuid.uuid4().hex
    tables = docs.sparkSession.sparkContext.broadcast((Automaton(path), word_pattern()))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from riskspark.llm import bpe  # the worker's module, whose encoder outlives the task

        encoder = bpe._encoder(name, tables)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [encoder.ids(t or "") for t in part.column(len(keep)).to_pylist()]
                decoded = [encoder.automaton.decode(np.frombuffer(p, "<u4").tolist()) for p in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*keep, "ids", "decoded"])

    return docs.select(*keep, text).mapInArrow(run, shape)

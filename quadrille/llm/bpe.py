"""BPE encoding and decoding by a tokenization automaton.

compile_automaton() takes the merges in order and adds one gadget each to a deterministic automaton over tokens. It
begins with one state that any base symbol leads back to. For the merge (u, v) -> t, the state reached by u is
replaced by a copy without the arc v (u can't be followed by v any more: they would have merged), and t gets an arc
wherever u had one, leading to where v led. A state is kept as its parent state, the arc that was taken away and the
step; an arc t exists wherever the arcs on its left spine do. A sequence of tokens is the one that the merges give if
and only if the automaton accepts it, and each word has one such sequence; encode_word() finds it by table look-ups.
Decoding emits the labels of the arcs.

Words are split as the vocabulary file says (NFC, lower case, its pattern). Texts of Latin-1 letters take one regular
expression; other texts are split by the file's own normaliser and pre-tokenizer.

Defined cases: null text is empty and has no tokens; repeated rows are encoded each; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words whose tokens a worker remembers.
CACHE_WORDS = 100_000
#: Longer tokens are looked for only in the lengths that tokens of the same first symbols have.
HEAD = 4


class Automaton:
    """Arcs are tokens; state_of[t] is the state that the arc t leads to, from wherever it is."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.labels = vocab, {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.step: dict[int, int] = {}
        self.parent, self.taken, self.at = [-1], [-1], [-1]
        self.state_of: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self._arcs.clear()
        # tokens that end a word, and others; of these, the lengths that there are with the same HEAD symbols, long ones first
        self.last = {t[:-4]: i for t, i in vocab.items() if t.endswith("</w>")}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith("</w>")}
        self.longest = max(map(len, self.last), default=1)
        self.short, lengths = tuple(range(HEAD - 1, 0, -1)), {}
        for t in self.inner:
            if len(t) >= HEAD:
                lengths.setdefault(t[:HEAD], set()).add(len(t))
        self.lengths: dict[str, tuple[int, ...]] = {h: (*sorted(x, reverse=True), *self.short) for h, x in lengths.items()}

    def _gadget(self, k: int, u: int, v: int, t: int) -> None:
        if t in self.step:
            raise ValueError(f"two merges make token {t}")
        self.left[t], self.step[t] = u, k
        before = self.state_of.get(v, 0)
        self.parent.append(self.state_of.get(u, 0))
        self.taken.append(v)
        self.at.append(k)
        self.state_of[u], self.state_of[t] = len(self.parent) - 1, before

    def compile(self) -> "Automaton":
        """The table of taken arcs by (token, arc): the step at which the state of token lost it."""
        # the states of one lineage share a table; a state sees the entries up to its own step
        self.base: list[tuple[dict[int, int], int]] = [({}, -1)]
        owner: dict[int, int] = {}
        for s in range(1, len(self.parent)):
            p = self.parent[s]
            table, limit = self.base[p]
            if p in owner or p == 0 or limit != self.at[p]:
                table = {a: k for a, k in table.items() if k <= limit}
            owner[p] = s
            table[self.taken[s]] = self.at[s]
            self.base.append((table, self.at[s]))
        return self

    def arc(self, state: int, t: int) -> bool:
        """Whether the state has the arc t."""
        key = state << 20 | t
        if (known := self._arcs.get(key)) is not None:
            return known
        table, limit = self.base[state]
        y, created, ok = t, 1 << 60, True
        while True:
            k = table.get(y)
            if k is not None and k <= limit and k <= created:
                ok = False
                break
            if y not in self.left:
                break
            created, y = self.step[y], self.left[y]
        if len(self._arcs) > 200_000:
            self._arcs.clear()
        self._arcs[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """word: its symbols, without the word end."""
        n, state_of, arcs, arc, last, inner, lengths = len(word), self.state_of, self._arcs, self.arc, self.last, self.inner, self.lengths
        tokens: list[int] = []
        places: list[tuple] = []  # position, state, sizes still to try
        dead: set[tuple[int, int]] = set()
        at, state, sizes = 0, 0, None
        while n:
            if sizes is None:
                if n - at <= self.longest and (t := last.get(word[at:])) is not None and arc(state, t):
                    tokens.append(t)
                    break
                sizes = iter(lengths.get(word[at : at + HEAD], self.short))
            for size in sizes:
                end = at + size
                if end < n and (t := inner.get(word[at:end])) is not None:
                    known = arcs.get(state << 20 | t)
                    if known or (known is None and arc(state, t)):
                        to = state_of.get(t, 0)
                        if not dead or (end, to) not in dead:
                            tokens.append(t)
                            places.append((at, state, sizes))
                            at, state, sizes = end, to, None
                            break
            else:
                if not places:
                    raise ValueError(f"no tokens for {word!r}")
                dead.add((at, state))
                at, state, sizes = places.pop()
                tokens.pop()
        return tokens


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if visible Latin-1, else 256 and on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Words(dict):
    """The tokens of words, as bytes; \\0 marks words that are in symbols already. Words not used for long are
    forgotten: of two halves the older one goes, but for what was used since."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.older, self.symbols = automaton, {}, byte_symbols()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            symbols = word[1:] if word[0] == "\0" else word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
            tokens = self.automaton.encode_word(symbols)
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ÿ]*\Z")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges).compile()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.labels[i] = t
        self._marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._path, self._library = path, None
        self._known = _Words(self.automaton)

    def _split(self, text: str) -> list[str]:
        """The words of a text, in byte symbols for texts beyond Latin-1."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        norm = self._library.normalizer.normalize_str(text)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(norm)] if norm else []

    def _part(self, text: str, out: list[bytes]) -> None:
        plain = _PLAIN.match(text) is not None
        words = _WORD.findall(text.lower()) if plain else ["\0" + w for w in self._split(text)]
        out.extend(map(self._known.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        at = 0
        for m in self._marks.finditer(text) if self._marks else ():
            self._part(text[at : m.start()], out)
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        self._part(text[at:] if at else text, out)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, joined by a blank as a file without a decoder says."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, compiled once a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids = e.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)

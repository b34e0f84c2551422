"""BPE encoding and decoding with a tokenization automaton.

``Automaton`` compiles a merge list. Its words are sequences of *tokens*, and it accepts exactly the
correct tokenizations. It starts as one state with an arc for each symbol. Each merge ``u v -> uv``, in
rank order, applies a gadget: the state that ``u`` leads to is copied without its arc ``v``, ``u`` is
redirected to the copy, and every state with an arc ``u`` gets an arc ``uv`` to where ``v`` leads. So every
token leads to one state, and what changes is the set of arcs that leave it; an arc is kept as its token and
the rank at which it was taken away. The outcome is compiled into flat arrays. All pairs of 49,000 tokens
would be 2.4 billion arcs, so a transition table of fixed size holds the arcs in use; one that is not in it
is worked out from the arrays. Every prefix of a word has one accepted path, so encoding is deterministic:
it advances from state to state by table look-ups, without a search, for all distinct words of a slice of a
batch at once. Decoding emits the labels of the arcs.

Texts are prepared as the tokenizer file says: special tokens are cut out of the raw text first, then NFC,
lower case (character by character, no final sigma rule) and the split pattern; white space falls away.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import give_back, slices

_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
WITH_ENDS = regex.compile(SPLIT.pattern + r"|\n")
END = "</w>"
SPACES = regex.compile(f"[{_SPACE}]+")
#: Separators of str.split that the split pattern does not take as white space.
ODD = regex.compile("[\\x1c-\\x1f]")
#: A worker remembers runs without white space up to this length: at least this many of those met last, at most twice as
#: many and what one slice of a batch holds. 131,072 take some 50 MB.
MEMO_CHARS, MEMO_WORDS = 40, 1 << 17
#: Slots of the transition table, as a power of two; words of up to this many bytes advance together.
ARC_BITS, TOGETHER = 19, 96
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Lookup:
    """A fixed map of distinct non-negative longs to ints in open addressing, read for many keys at once; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.key, self.value = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[slot[left]] < 0]
            own, first = np.unique(slot[free], return_index=True)
            self.key[own], self.value[own] = keys[free[first]], values[free[first]]
            left = left[self.key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, there = self.value[slot], self.key[slot]
        left = np.flatnonzero((there != keys) & (there >= 0))
        out[there != keys] = -1
        while len(left):
            slot[left] = (slot[left] + 1) % (len(self.key) - 1)
            there = self.key[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Automaton:
    """``token``: label -> id of the tokens that some text leads to. Arrays are indexed by token id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.label = {i: t for t, i in vocab.items()}
        self.token = {}
        never = len(merges) + 1
        #: (u, v) -> rank at which the state of u lost its arc v.
        lost: dict[tuple[int, int], int] = {}
        #: The tokens whose arcs a state has inherited, each with the rank up to which it did; likewise of what an arc was made.
        state: dict[int, list[tuple[int, int]]] = {}
        made: dict[int, list[tuple[int, int]]] = {}

        def exists(a: int, b: int, before: int) -> bool:
            for x, kept in state[a]:
                for y, alone in made[b]:
                    rank = lost.get((x, y))
                    if rank is not None and rank < min(kept, before) and rank <= alone:
                        return False
            return True

        inner = {u + v for u, v in merges}
        for t, i in vocab.items():
            if t not in inner:
                state[i] = made[i] = [(i, never)]
                self.token[t] = i
        for rank, (u, v) in enumerate(merges):
            if u not in self.token or v not in self.token:
                continue  # a part that no text leads to
            a, b = self.token[u], self.token[v]
            there = exists(a, b, rank)
            lost.setdefault((a, b), rank)
            if not there or u + v in self.token:
                continue
            c = vocab[u + v]
            self.token[u + v] = c
            made[c] = [(c, never)] + [(x, min(until, rank)) for x, until in made[a]]
            state[c] = [(c, never)] + [(x, min(until, rank)) for x, until in state[b]]
        size = max(vocab.values(), default=0) + 1
        self.start = size
        self.state, self.made = self._flat(state, size), self._flat(made, size)
        self.lost = Lookup(np.array([a << 20 | b for a, b in lost], np.int64), np.array(list(lost.values()), np.int32))
        #: The transition table: state and token, and whether the arc exists; a slot holds the pair that came last.
        self.arc_key, self.arc_open = np.full(1 << ARC_BITS, -1, np.int64), np.zeros(1 << ARC_BITS, bool)
        self._spell(size)

    @staticmethod
    def _flat(lists: dict[int, list[tuple[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray]:
        wide = max(map(len, lists.values()), default=1)
        token, until = np.full((size, wide), -1, np.int32), np.zeros((size, wide), np.int32)
        for i, entries in lists.items():
            for k, (x, rank) in enumerate(entries):
                token[i, k], until[i, k] = x, rank
        return token, until

    def _spell(self, size: int) -> None:
        """Labels by their bytes: edges (node and byte -> node), and the tokens that end at a node, inside a word or with it."""
        byte = {c: b for b, c in byte_letters().items()}
        edges: dict[int, int] = {}
        inside, last = [-1], [-1]
        self.bytes = np.zeros(size + 1, np.int64)
        for t, i in self.token.items():
            ends = t.endswith(END) and t != END
            letters = t.removesuffix(END) if ends else t
            if any(c not in byte for c in letters):
                continue
            node = 0
            for c in letters:
                new = edges.setdefault(node << 8 | byte[c], len(inside))
                if new == len(inside):
                    inside.append(-1), last.append(-1)
                node = new
            (last if ends else inside)[node] = i
            self.bytes[i] = len(letters)
        self.edges = Lookup(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.inside, self.last = np.array(inside, np.int32), np.array(last, np.int32)

    def _compiled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arcs exist, from what the gadgets left in the flat arrays."""
        there = np.ones(len(a), bool)
        for k in range(self.state[0].shape[1]):
            for j in range(self.made[0].shape[1]):
                some = np.flatnonzero(there & (self.state[0][a, k] >= 0) & (self.made[0][b, j] >= 0))
                if not len(some):
                    break
                p, q = a[some], b[some]
                rank = self.lost.get(self.state[0][p, k].astype(np.int64) << 20 | self.made[0][q, j])
                there[some[(rank >= 0) & (rank < self.state[1][p, k]) & (rank <= self.made[1][q, j])]] = False
        return there

    def arcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the states of tokens ``a`` have arcs ``b``; the start has all, and -1 none."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * SPREAD) >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        there = self.arc_open[slot]
        new = np.flatnonzero((self.arc_key[slot] != key) & (a >= 0) & (a < self.start))
        if len(new):
            own, back = np.unique(key[new], return_inverse=True)
            there[new] = self._compiled(own >> 20, own & 0xFFFFF)[back.ravel()]
            self.arc_key[slot[new]], self.arc_open[slot[new]] = key[new], there[new]
        return (there | (a == self.start)) & (a >= 0)

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (none empty) one after another, and how many each has.

        After every prefix of a word the automaton is in one state, that of the last token of the one
        accepted path. So the state after k bytes follows from the states before and the tokens that end
        there: exactly one of them has an arc. All words advance together, a byte at a time.
        """
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        end = np.cumsum(size)
        begin = end - size
        first, stop = np.repeat(begin, size), np.repeat(end, size)
        at, node, found = np.arange(len(data)), np.zeros(len(data), np.int64), []
        to = at
        while len(at):
            node = self.edges.get(node << 8 | data[to])
            some = node >= 0
            at, to, node = at[some], to[some] + 1, node[some].astype(np.int64)
            whole = to == stop[at]
            token = np.where(whole, self.last[node], self.inside[node])
            hit = token >= 0
            found.append((at[hit], to[hit], token[hit]))
            at, to, node = at[~whole], to[~whole], node[~whole]
        at, to, token = (np.concatenate(x) for x in zip(*found, strict=True))
        step = to - first[at]
        long = size[np.searchsorted(end, at, side="right")] > TOGETHER
        state = np.full(len(data), -1, np.int64)
        order = np.argsort(np.where(long, 0, step).astype(np.uint16), kind="stable")
        at, to, token, from_start = at[order], to[order], token[order], (at == first[at])[order]
        cut = np.searchsorted(np.where(long, 0, step)[order], np.arange(TOGETHER + 2))
        for k in range(1, TOGETHER + 1):
            a, b = cut[k], cut[k + 1]
            if a < b:
                before = np.where(from_start[a:b], self.start, state[at[a:b] - 1])
                go = self.arcs(before, token[a:b])
                state[to[a:b][go] - 1] = token[a:b][go]
        if cut[1]:
            order = np.argsort(to[: cut[1]], kind="stable")
            self._alone(at[order].tolist(), to[order].tolist(), token[order].tolist(), from_start[order].tolist(), state)
        if (state < 0).any():
            bad = np.searchsorted(end, np.flatnonzero(state < 0)[0], side="right")
            raise ValueError(f"no tokenization of {words[bad]!r}")
        used = np.zeros(len(data), bool)
        for x, y in zip(begin[size > TOGETHER].tolist(), end[size > TOGETHER].tolist(), strict=True):
            own, width = state[x:y].tolist(), self.bytes[state[x:y]].tolist()
            k = len(own)
            while k > 0:
                used[x + k - 1] = True
                k -= width[k - 1]
        here, low = end[size <= TOGETHER], begin[size <= TOGETHER]
        while len(here):
            used[here - 1] = True
            here = here - self.bytes[state[here - 1]]
            here, low = here[here > low], low[here > low]
        return state[used], np.add.reduceat(used.astype(np.int64), begin) if len(begin) else size

    def _alone(self, at: list[int], to: list[int], token: list[int], from_start: list[bool], state: np.ndarray) -> None:
        """Advances through long words by themselves."""
        keys, there = self.arc_key, self.arc_open
        reached: dict[int, int] = {}
        for i, j, t, begins in zip(at, to, token, from_start, strict=True):
            before = self.start if begins else reached.get(i, -1)
            if before == self.start:
                reached[j] = t
            elif before >= 0:
                key = before << 20 | t
                slot = (key * int(SPREAD) & (1 << 64) - 1) >> (64 - ARC_BITS)
                if keys[slot] != key:
                    self.arcs(np.array([before]), np.array([t]))
                if there[slot]:
                    reached[j] = t
        for j, t in reached.items():
            state[j - 1] = t

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in byte letters."""
        byte = {c: b for b, c in byte_letters().items()}
        return self.encode_all([bytes(byte[c] for c in word)])[0].tolist()


class Codec:
    """A tokenizer file: text to ids, ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.automaton.label | {i: t for t, i in self.special.items()}
        #: What stands for each token; the last entry ends a word.
        self.names = [*(str(i) for i in range(self.automaton.start)), "\n"]
        self.labels = [*(self.label.get(i, "") for i in range(self.automaton.start)), "\n"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Runs without white space and their ids and labels, joined: those met lately, and those met before them.
        self.young: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def _learn(self, chunks: list[str]) -> None:
        """Encodes runs of text without white space into the young dictionaries, all at once."""
        low = "\n".join(chunks)
        low = low.lower() if low.isascii() else unicodedata.normalize("NFC", low).replace("Σ", "σ").lower()
        parts = WITH_ENDS.findall(low)
        words = list(dict.fromkeys(parts))
        if "\n" in words:
            words.remove("\n")
        token, many = self.automaton.encode_all([w.encode() for w in words])
        token = np.insert(token, np.cumsum(many)[:-1], self.automaton.start).tolist()
        for known, names in zip(self.young, (self.names, self.labels), strict=True):
            of = dict(zip(words, _apart(map(names.__getitem__, token)), strict=True))
            of["\n"] = "\n"
            known.update(zip(chunks, _apart(map(of.__getitem__, parts)), strict=True))

    def encode_all(self, texts: list[str], remember: int = MEMO_WORDS) -> list[tuple[int, str, str]]:
        """Of each text the number of tokens, ids joined by spaces, and labels joined by spaces; up to twice ``remember`` runs are kept for later texts."""
        cut, here = [], set()
        for text in texts:
            parts = []
            for part in self.cut.split(text) if self.cut and any(t in text for t in self.special) else (text,):
                if part not in self.special:
                    part = list(filter(None, SPACES.split(part))) if ODD.search(part) else part.split()
                    here.update(part)
                parts.append(part)
            cut.append(parts)
        young, old = self.young, self.old
        new = here.difference(young[0])
        again = new.intersection(old[0])
        for known, before in zip(young, old, strict=True):
            known.update(zip(again, map(before.__getitem__, again), strict=True))
        if new := list(new.difference(again)):
            self._learn(new)
        out = []
        for parts in cut:
            ids, labels = (
                " ".join(filter(None, [special(part) if isinstance(part, str) else " ".join(map(known.__getitem__, part)) for part in parts]))
                for known, special in ((young[0], lambda t: str(self.special[t])), (young[1], str))
            )
            out.append((ids.count(" ") + bool(ids), ids, labels))
        for chunk in here:
            if len(chunk) > MEMO_CHARS:
                del young[0][chunk], young[1][chunk]
        if len(young[0]) > remember:
            self.old, self.young = young, ({}, {})
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids])

    def __getstate__(self) -> dict:
        """What is sent to workers: the tables, without what was remembered here."""
        return self.__dict__ | {"young": ({}, {}), "old": ({}, {})}


def _apart(names: Iterator[str]) -> list[str]:
    """Names joined by spaces, apart where a name is the line feed."""
    return " ".join(names).replace(" \n", "\n").replace("\n ", "\n").split("\n")


def codec(path: str) -> Codec:
    """The codec of a file, compiled anew: that takes some 1.5 s, and one that the driver kept would take 80 MB of its memory for ever."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, remember: int = MEMO_WORDS, most: int = 1 << 21) -> DataFrame:
    """Encodes every text and decodes it again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space),
    ``decoded_sha256`` and, with ``ids``, the ids themselves. A null text counts as empty: no tokens.
    Each row stands alone (repeated rows give repeated results); other columns are not read, and an
    empty table gives an empty result. ``path`` is a tokenizer file that the driver can open; the compiled tables
    (some 20 MB for 49,000 tokens, whatever the corpus) are broadcast, and leave the workers with the query.
    ``remember`` and ``most`` (bytes of text taken at once) trade a worker's memory for its time; results don't depend on them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codec(path))
    give_back()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, text_col, most):
                rows = c.encode_all([t or "" for t in part.column(1).to_pylist()], remember)
                out = [
                    part.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([sha(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([sha(r[2].encode()).hexdigest() for r in rows], pa.string()),
                ]
                if ids:
                    names = pc.split_pattern(pa.array([r[1] or None for r in rows], pa.string()), " ")
                    none = pa.array([[]] * len(rows), pa.list_(pa.int32()))
                    out.append(pc.coalesce(names.cast(pa.list_(pa.int32())), none))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return docs.select(id_col, text_col).mapInArrow(run, schema)

"""Language identification by unigrams of pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary. For each language a piece has a probability, and the
probability of a word is the sum over all ways to cut it into pieces (a word begins with the vocabulary's
word mark; a character outside the vocabulary is a piece of its own with a small fixed probability). A
forward pass gives that sum. Probabilities are learned by expectation-maximisation with forward-backward
counts on the words of at most about ``SAMPLE`` training texts of each language, taken by a hash of the id;
word counts and expected counts are made by Spark, and only pieces times languages come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, slices

SAMPLE = 800
ROUNDS = 2
MARK = "▁"
UNKNOWN = 1e-7
WORD = regex.compile(r"\p{L}+")
#: Longer runs of letters are cut here, so that probabilities stay above the smallest double.
LONGEST = 28
MEMO_WORDS = 500_000


class Pieces:
    """The vocabulary as a trie of characters; "" holds the number of the piece that ends there."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]]
        self.trie: dict = {}
        for i, piece in enumerate(self.names):
            at = self.trie
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = i
        self.unknown = len(self.names)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece) of every piece that matches somewhere, ordered by end."""
        out: list[tuple[int, int, int, int]] = []
        for w, word in enumerate(words):
            for i in range(len(word)):
                node, j, alone = self.trie, i, True
                while j < len(word) and (node := node.get(word[j])) is not None:
                    j += 1
                    if (piece := node.get("")) is not None:
                        out.append((w, i, j, piece))
                        alone = alone and j > i + 1
                if alone:
                    out.append((w, i, i + 1, self.unknown))
        arcs = np.array(out, np.int64).reshape(-1, 4)
        return tuple(arcs[np.argsort(arcs[:, 2], kind="stable")].T)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones cut."""
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def forward(vocab: Pieces, words: list[str], p: np.ndarray) -> tuple[np.ndarray, tuple]:
    """alpha[word, position, language]: probability of all segmentations of the word up to a position; and the arcs."""
    words = [MARK + w for w in words]
    arcs = vocab.arcs(words)
    w, i, j, piece = arcs
    alpha = np.zeros((len(words), max(map(len, words), default=0) + 1, p.shape[1]))
    alpha[:, 0] = 1
    cut = np.searchsorted(j, np.arange(1, alpha.shape[1] + 1))
    for end in range(1, alpha.shape[1]):
        s = slice(cut[end - 1], cut[end])
        np.add.at(alpha[:, end], w[s], alpha[w[s], i[s]] * p[piece[s]])
    return alpha, arcs


def expected(vocab: Pieces, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that stand ``times`` often, for one language (p has one column)."""
    alpha, (w, i, j, piece) = forward(vocab, words, p)
    length = np.array([len(x) + 1 for x in words])
    beta = np.zeros(alpha.shape[:2])
    beta[np.arange(len(words)), length] = 1
    order = np.argsort(-i, kind="stable")
    w, i, j, piece = w[order], i[order], j[order], piece[order]
    cut = np.searchsorted(-i, np.arange(-alpha.shape[1], 2))
    for k in range(len(cut) - 1):
        s = slice(cut[k], cut[k + 1])
        np.add.at(beta, (w[s], i[s]), beta[w[s], j[s]] * p[piece[s], 0])
    total = alpha[np.arange(len(words)), length, 0]
    use = alpha[w, i, 0] * p[piece, 0] * beta[w, j] / total[w] * times[w]
    return np.bincount(piece, weights=use, minlength=vocab.unknown + 1)


class Model:
    def __init__(self, path: str, langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.path, self.langs, self.p, self.prior = path, langs, p, prior

    def score(self, texts: list[str | None], memo: dict) -> tuple[list[str], np.ndarray]:
        """Predicted languages and their posteriors. ``memo`` keeps log probabilities of words between calls."""
        split = [words_of(t) if t else [] for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        index, rows = memo.setdefault("index", {}), memo.setdefault("rows", [])
        if len(index) > MEMO_WORDS:
            index.clear(), rows.clear()
        new = list({w for words in split for w in words if w not in index})
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            alpha, _ = forward(pieces(self.path), some, self.p)
            for w in some:
                index[w] = len(index)
            rows.append(np.log(alpha[np.arange(len(some)), [len(w) + 1 for w in some]]))
        if rows:
            rows[:] = [rows[0] if len(rows) == 1 else np.concatenate(rows)]
        size = np.array([len(s) for s in split])
        flat = np.fromiter((index[w] for words in split for w in words), np.int64, int(size.sum()))
        total = np.zeros((len(texts), len(self.langs)))
        if len(flat):
            some = np.flatnonzero(size)
            total[some] = np.add.reduceat(rows[0][flat], (np.cumsum(size) - size)[some])
        total += self.prior
        total -= total.max(axis=1, keepdims=True)
        posterior = np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        found = size > 0
        return [self.langs[b] if f else "und" for b, f in zip(best, found, strict=True)], np.where(found, posterior[np.arange(len(best)), best], 0.0)


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from texts with a language whose fold (crc32 of the id, 5 folds) is not 0.

    Languages are the values of ``lang_col``; their number is that of a catalogue, and they come to the driver.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 5) != 0))
    found = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(lang_col).collect()
    langs = [r[0] for r in found]
    vocab = pieces(path)
    size = vocab.unknown + 1
    if not langs:
        return Model(path, [], np.zeros((size, 0)), np.zeros(0))
    pick = F.lit(False)
    unit = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    for r in found:
        pick |= (F.col(lang_col) == r[0]) & (unit < sample / r["n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                rows = [(lang, w) for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in words_of(t)]
                if rows:
                    count = pd.DataFrame(rows, columns=["lang", "word"]).groupby(["lang", "word"]).size()
                    frame = count.rename("times").reset_index()
                    yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("times", pa.int64())]), preserve_index=False)

    counts = known.where(pick).select(F.col(lang_col).cast("string").alias("lang"), text_col).mapInArrow(split, "lang string, word string, times long")
    counts = counts.groupBy("lang", "word").agg(F.sum("times").alias("times")).persist()
    p = np.full((size, len(langs)), 1.0 / size)
    at = {str(lang): k for k, lang in enumerate(langs)}
    try:
        for _ in range(ROUNDS):

            def count(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
                total: dict[str, np.ndarray] = {}
                for batch in batches:
                    frame = batch.to_pandas()
                    for lang, own in frame.groupby("lang"):
                        for k in range(0, len(own), 4096):
                            some = own.iloc[k : k + 4096]
                            use = expected(pieces(path), some["word"].tolist(), some["times"].to_numpy(float), p[:, [at[lang]]])
                            total[lang] = total.get(lang, 0) + use
                for lang, use in total.items():
                    some = np.flatnonzero(use)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(use[some])], names=["lang", "piece", "uses"])

            uses = counts.mapInArrow(count, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
            new = np.full((size, len(langs)), 0.01)
            new[uses["piece"].to_numpy(), [at[x] for x in uses["lang"]]] += uses["uses"].to_numpy()
            p = new / new.sum(axis=0)
            p[vocab.unknown] = UNKNOWN
    finally:
        counts.unpersist()
    n = np.array([r["n"] for r in found], float)
    return Model(path, [str(x) for x in langs], p, np.log(n / n.sum()))


def identify_languages(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Texts that are null or hold no letter are ``und`` with score 0, and so are all if nothing could be
    learned. Repeated rows give repeated results; other columns are not read; an empty table gives an
    empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, path, id_col, text_col, lang_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = sent.value, {}
        for batch in batches:
            for part in slices(batch, text_col):
                lang, score = model.score(part.column(2).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(id_col, (fold(id_col, 5) == 0).alias("held_out"), text_col)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")

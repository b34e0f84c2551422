"""N-gram language model with deleted interpolation, learned and applied over all texts.

Tokens are the lower-cased words of a text and one end. A token's probability mixes its maximum-likelihood
estimates given the token before (order 2), alone (order 1) and the uniform one over the vocabulary and an
unknown word (order 0). The weights depend on how often the context was seen, in buckets of powers of two,
and are learned by expectation-maximisation on held-out counts: each token of a part of the training texts
is deleted from the counts before it is predicted.

Counts are exchanged in packed form. Texts are dealt into blocks of a few MB. A block asks for each of its
distinct n-grams once, with the number of times its training texts hold it; requests are dealt by hash into
buckets, where the counts of an n-gram meet, and the totals go back to the blocks in the order of the
requests. A frequent n-gram therefore costs one entry a block. N-grams are known by hashes: the bucket and 48
further bits for tokens, 40 for pairs, so that two different ones of a bucket of a million share them with a
chance of about 1e-8 and 1e-6. Keys travel sorted, as differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, fold, utf8
from tidemark.llm.shingles import mix, words

END, BEGIN = np.uint64(0x51ED270B9F3A6C17), np.uint64(0xA24BAED4963EE407)
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: Bytes of a key within its bucket, for tokens and pairs.
WIDTHS = (6, 5)
#: Steps of the grid on which the statistics for the weights are kept, a power of two.
STEP = 4
ROUNDS = 60


def _count(total: int, small: int, large: int) -> int:
    """Parts of about ``small`` each, larger where that makes over 4096 parts, up to ``large``; 96 at least."""
    return max(96, min(total // small, 4096), total // large)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows, the tokens before them, and each row's start (rows + 1)."""
    rows = len(offsets) - 1
    word, row = words(data, offsets)
    start = np.append(0, np.cumsum(np.bincount(row, minlength=rows) + 1))
    token = np.full(start[-1], END, np.uint64)
    token[np.arange(len(word)) + row] = word
    before = np.append(BEGIN, token[:-1])
    before[start[:-1]] = BEGIN
    return token, before, start


def _distinct(key: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (the low ``width`` bytes) ordered by bucket and key, their buckets, and the place of each key among them."""
    own, back = np.unique(key, return_inverse=True)
    bucket = ((own >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    low = own & np.uint64((1 << 8 * width) - 1)
    order = np.lexsort((low, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return low[order], bucket[order], place[back.ravel()]


def _ngrams(token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return token, mix(before * _PAIR + token)


def _zip(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _zip_keys(key: np.ndarray, width: int) -> bytes:
    """Sorted keys as differences, byte by byte, so that the high bytes compress away."""
    steps = np.diff(key, prepend=np.uint64(0)).astype("<u8")
    return _zip(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T))


def _unzip_keys(x: bytes, width: int) -> np.ndarray:
    planes = _unzip(x, "u1").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _unzip(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), kind)


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each block: ids, held_out, deleted and numbers of tokens of its texts, the packed training
    counts of its tokens (``ones``) and of their pairs with the token before (``twos``), and ``fresh``, its
    share in the size of the vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = _count(size["n"] + size["rows"], 1 << 23, 1 << 24)
    buckets = _count((size["n"] + size["rows"]) // 6, 1_000_000, 4_000_000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    dealt = docs.select(
        F.pmod(F.xxhash64(id_col, F.crc32(F.encode(text, "UTF-8"))), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).alias("id"), (fold(id_col, 7) == 2).alias("held_out"), (fold(id_col, 7) == 6).alias("deleted"), text.alias("text"),
    )

    def request(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        token, before, start = _tokens(*utf8(table.column("text").chunk(0)))
        learned = np.repeat(~np.asarray(table.column("held_out")), np.diff(start))
        columns, there = [], None
        for key, width in zip(_ngrams(token, before), WIDTHS, strict=True):
            own, bucket, place = _distinct(key, buckets, width)
            times = np.bincount(place[learned], minlength=len(own)).astype(np.uint32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            there = used if there is None else np.union1d(there, used)
            columns.append((own, times, cut))
        block = table.column("block")[0].as_py()
        out = {"bucket": pa.array(there.astype(np.int32)), "block": pa.array(np.full(len(there), block, np.int32))}
        for name, width, (own, times, cut) in zip(("one", "two"), WIDTHS, columns, strict=True):
            ends = [(cut[b], cut[b + 1]) for b in there]
            out[f"{name}_keys"] = pa.array([_zip_keys(own[x:y], width) for x, y in ends], pa.binary())
            out[f"{name}_times"] = pa.array([_zip(times[x:y]) for x, y in ends], pa.binary())
        return pa.table(out)

    def answer(table: pa.Table) -> pa.Table:
        packed, fresh = [], None
        for name, width in zip(("one", "two"), WIDTHS, strict=True):
            parts = [_unzip_keys(x, width) for x in table.column(f"{name}_keys").to_pylist()]
            cut = np.append(0, np.cumsum([len(p) for p in parts]))
            times = np.concatenate([_unzip(x, "u4") for x in table.column(f"{name}_times").to_pylist()])
            _, first, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
            total = np.bincount(back.ravel(), weights=times).astype(np.uint32)
            if fresh is None:
                fresh = np.bincount(np.searchsorted(cut, first[total > 0], side="right") - 1, minlength=len(cut) - 1)
            each = total[back.ravel()]
            packed.append([_zip(each[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ones": pa.array(packed[0], pa.binary()), "twos": pa.array(packed[1], pa.binary()), "fresh": pa.array(fresh)})

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        token, before, start = _tokens(*utf8(left.column("text").chunk(0)))
        right = right.sort_by("bucket")
        packed = []
        for name, key, width in zip(("ones", "twos"), _ngrams(token, before), WIDTHS, strict=True):
            _, _, place = _distinct(key, buckets, width)
            totals = np.concatenate([_unzip(x, "u4") for x in right.column(name).to_pylist()])
            packed.append(_zip(totals[place]))

        def whole(column: pa.ChunkedArray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.combine_chunks())

        return pa.table(
            {
                "ids": whole(left.column("id")), "held_out": whole(left.column("held_out")), "deleted": whole(left.column("deleted")),
                "tokens": whole(pa.chunked_array([pa.array(np.diff(start))])), "ones": pa.array([packed[0]], pa.binary()), "twos": pa.array([packed[1]], pa.binary()),
                "fresh": pa.array([int(np.asarray(right.column("fresh")).sum())], pa.int64()),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(request, "bucket int, block int, one_keys binary, one_times binary, two_keys binary, two_times binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, ones binary, twos binary, fresh long")
    schema = f"ids array<{kind}>, held_out array<boolean>, deleted array<boolean>, tokens array<long>, ones binary, twos binary, fresh long"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(take, schema)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two in its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _unpack(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Numbers of tokens, starts, counts of tokens, of pairs, and of contexts in a block."""
    row = {name: batch.column(name)[k] for name in ("tokens", "ones", "twos")}
    tokens = np.array(row["tokens"].as_py(), np.int64)
    start = np.append(0, np.cumsum(tokens))
    one, two = (_unzip(row[name].as_py(), "u4").astype(np.int64) for name in ("ones", "twos"))
    context = np.append(0, one[:-1])
    context[start[:-1]] = one[start[1:] - 1]  # as many begins as ends
    return tokens, start, one, two, context


def learn_weights(cells: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights of orders 2, 1 and 0 by bucket of the context, by expectation-maximisation.

    ``cells``: bucket, two and one (grid steps below 0 of log2 of the estimates, -1 for an estimate of 0) and
    times. Buckets without a cell get the weights of all cells together; one count is added to each order.
    """
    def estimate(step: pd.Series) -> np.ndarray:
        s = step.to_numpy(float)
        return np.where(s < 0, 0.0, 2.0 ** (-s / STEP))

    def run(own: pd.DataFrame) -> np.ndarray:
        f = np.stack([estimate(own["two"]), estimate(own["one"]), np.full(len(own), uniform)], 1)
        times = own["times"].to_numpy(float)
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(ROUNDS):
            part = f * w
            w = (part / part.sum(1, keepdims=True) * times[:, None]).sum(0) + 1
            w /= w.sum()
        return w

    pooled = run(cells) if len(cells) else np.array([0.3, 0.4, 0.3])
    out = np.tile(pooled, (64, 1))
    for b, own in cells.groupby("bucket"):
        out[b] = run(own)
    out[0, 0] = 0
    return out / out.sum(1, keepdims=True)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts consist of their end. Texts whose fold (crc32 of the id, 7 folds) is 2 are held out
    of all counts. Repeated rows count as often as they stand and get equal scores; other columns are not
    read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpoint(counted(docs, id_col, text_col))
    each = rows.select("fresh", F.aggregate(F.arrays_zip("tokens", "held_out"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held_out"], 0).otherwise(x["tokens"])).alias("n"))
    found = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("v")).first()
    n, v = int(found["n"]), int(found["v"])

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens, _, one, two, context = _unpack(batch, k)
                some = np.repeat(np.array(batch.column("deleted")[k].as_py(), bool), tokens)
                one, two, context = one[some] - 1, two[some] - 1, context[some] - 1
                if not len(one):
                    continue

                def grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    f = a / np.maximum(b, 1)
                    return np.where(a > 0, np.round(-STEP * np.log2(np.where(a > 0, f, 1))), -1).astype(np.int64)

                cells = np.stack([_bucket(context), grid(two, context), grid(one, np.full(len(one), max(n - 1, 1)))], 1)
                cells, times = np.unique(cells, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(times)], names=["bucket", "two", "one", "times"])

    cells = rows.select("tokens", "deleted", "ones", "twos").mapInArrow(statistics, "bucket long, two long, one long, times long")
    weights = learn_weights(cells.groupBy("bucket", "two", "one").agg(F.sum("times").alias("times")).toPandas(), 1 / (v + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens, start, one, two, context = _unpack(batch, k)
                w = weights[_bucket(context)]
                p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
                total = np.add.reduceat(np.log10(p), start[:-1])
                base = np.add.reduceat(np.log10(one + 1.0), start[:-1]) - tokens * math.log10(n + v + 1)
                known = np.add.reduceat((one > 0).astype(np.int64), start[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, batch.column("held_out")[k].values, pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), n)), pa.array(base), pa.array(total)],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.select("ids", "held_out", "tokens", "ones", "twos").mapInArrow(score, schema)

"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs (lines, cut further at sentence ends and at ``PIECE`` characters, so that an
edit inside one long line changes a part of its cells only). The k-th copy of a paragraph counts as an
element of its own. An element has a 64-bit key; it goes into one cell of each of three parts of a table,
where a cell holds a count, the exclusive or of the keys and the exclusive or of their check values. Tables
of two versions subtract cell by cell: what both hold cancels. Peeling then takes keys out of cells with a
single element until all cells are empty; if it gets stuck, both versions are sketched again four times as
large. What comes out are the paragraphs that one version has and the other has not, and the likeness is
the share of common paragraphs among all of both (1 for two texts without any).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, slices
from tidemark.llm.shingles import mix

CELLS = 48
PIECE = 120
#: A cut into pieces: up to PIECE characters of a line, ended early by a sentence end.
_PIECES = re.compile(rf"[^\n]{{1,{PIECE}}}?(?:[.!?](?= )|(?=\n|\Z))|[^\n]{{{PIECE}}}")
_PARTS = 3
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0x27D4EB2F165667C5)


def keys(text: str) -> np.ndarray:
    """Keys of a text's paragraphs; the k-th copy of a paragraph has another key than the first."""
    seen: dict[int, int] = {}
    out = []
    digest = xxhash.xxh3_64_intdigest
    for piece in _PIECES.findall(text):
        d = digest(piece)
        k = seen.get(d, 0)
        seen[d] = k + 1
        out.append(d if k == 0 else digest(f"{d}:{k}"))
    return np.array(out, np.uint64)


def places(key: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each part of a table; one row for a part."""
    part = cells // _PARTS
    at = mix(key[None, :] ^ _SEEDS[:, None]) % np.uint64(part)
    return at.astype(np.int64) + (np.arange(_PARTS) * part)[:, None]


class Tables:
    """A table of ``cells`` cells for each of many versions, side by side in flat arrays."""

    def __init__(self, cells: int, versions: list[np.ndarray]):
        self.cells, self.n = cells, len(versions)
        size = self.n * cells
        self.count = np.zeros(size, np.int64)
        self.key, self.check = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        if versions:
            self.add(np.concatenate(versions), np.repeat(np.arange(self.n), [len(v) for v in versions]), 1)

    def add(self, key: np.ndarray, of: np.ndarray, sign: np.ndarray | int) -> None:
        at = places(key, self.cells) + of * self.cells
        check = mix(key + _CHECK)
        for row in at:
            np.add.at(self.count, row, sign)
            np.bitwise_xor.at(self.key, row, key)
            np.bitwise_xor.at(self.check, row, check)

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.cells, [])
        out.n = self.n
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(version, key, sign) of all that can be taken out, and which versions got stuck. Empties the tables."""
        found = []
        single = np.flatnonzero(np.abs(self.count) == 1)
        while True:
            single = single[np.abs(self.count[single]) == 1]
            single = single[mix(self.key[single] + _CHECK) == self.check[single]]
            if not len(single):
                break
            of, key, sign = single // self.cells, self.key[single], self.count[single]
            order = np.lexsort((key, of))
            of, key, sign = of[order], key[order], sign[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
            of, key, sign = of[new], key[new], sign[new]
            found.append((of, key, sign))
            self.add(key, of, -sign)
            single = np.unique(places(key, self.cells) + of * self.cells)
        stuck = (self.count != 0) | (self.key != 0) | (self.check != 0)
        stuck = stuck.reshape(self.n, self.cells).any(axis=1)
        of, key, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return of, key, sign, stuck

    def texts(self, sizes: list[int]) -> list[str]:
        """The number of elements and the table of each version, in hex."""
        shape = (self.n, self.cells)
        parts = [x.reshape(shape) for x in (self.count.astype("<u4"), self.key.astype("<u8"), self.check.astype("<u4"))]
        return [f"{size:x}." + "".join(x[k].tobytes().hex() for x in parts) for k, size in enumerate(sizes)]


def differences(a: list[np.ndarray], b: list[np.ndarray], ta: Tables | None = None, tb: Tables | None = None, cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of versions the keys of the first only and of the second only; tables of ``cells`` cells may be given."""
    out: list = [None] * len(a)
    open_ = list(range(len(a)))
    while open_:
        ta = ta or Tables(cells, [a[i] for i in open_])
        tb = tb or Tables(cells, [b[i] for i in open_])
        of, key, sign, stuck = ta.minus(tb).peel()
        order = np.argsort(of, kind="stable")
        of, key, sign = of[order], key[order], sign[order]
        cut = np.searchsorted(of, np.arange(len(open_) + 1))
        again = []
        for k, i in enumerate(open_):
            if stuck[k]:
                again.append(i)
            else:
                x, y = key[cut[k] : cut[k + 1]], sign[cut[k] : cut[k + 1]]
                out[i] = x[y > 0], x[y < 0]
        open_, ta, tb, cells = again, None, None, cells * 4
    return out


def likenesses(a: list[np.ndarray], b: list[np.ndarray], ta: Tables | None = None, tb: Tables | None = None) -> list[float]:
    """Common paragraphs over all paragraphs of both versions of each pair; 1 where neither has any."""
    out = []
    for x, y, (only, _) in zip(a, b, differences(a, b, ta, tb), strict=True):
        common = len(x) - len(only)
        out.append(common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next document.

    The next document is the one that follows in descending id; after the last comes the first again, so a
    single document follows itself. Ids are whole numbers (others raise). Null texts count as empty, null ids
    come last, rows that share an id are ordered by text and stand in one range. Other columns are not read; an empty table gives an empty result.

    Ids are cut into ranges of about equal counts at approximate percentiles. Each range is sorted and
    read as a stream that holds two documents; to know what follows its last document it also gets the
    first of the next range, whose id comes from one aggregate row per range.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    blocks = blocks or min(4 * shuffle_partitions(spark), 4096)
    cuts = slim.select(F.percentile_approx("id", F.array(*[F.lit(k / blocks) for k in range(1, blocks)]), 20 * blocks).alias("cuts")).first()["cuts"] if blocks > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64), side="left")).astype(np.int32))

    # Without nulls ids stay whole numbers in the batch; null ids come last.
    placed = slim.withColumn("block", F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(block_of(F.coalesce("id", F.lit(0).cast("long")))))
    first = placed.select("id", "block").groupBy("block").agg(F.max("id").alias("id")).orderBy("block").collect()
    # At most one row for each range: the ids that ranges begin with, and the range before.
    before = {r["id"]: first[k - 1]["block"] for k, r in enumerate(first)}
    if before:
        table = spark.createDataFrame(list(before.items()), "start long, ahead int")
        marked = placed.join(F.broadcast(table), F.col("id").eqNullSafe(F.col("start")), "left")
        own = F.struct("block", F.lit(0).alias("extra"))
        both = F.array(own, F.struct(F.col("ahead").alias("block"), F.lit(1).alias("extra")))
        to = F.explode(F.when(F.col("ahead").isNull(), F.array(own)).otherwise(both)).alias("to")
        placed = marked.select("id", text_col, to).select("id", text_col, "to.block", "to.extra")
    else:
        placed = placed.withColumn("extra", F.lit(0))
    streams = placed.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "extra", F.desc_nulls_last("id"), text_col)

    def results(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        """Rows of (document, next document) pairs."""
        changed = [edited(doc[1], following[1]) for doc, following in pairs]
        own, other, ahead = [d[2] for d, _ in pairs], [keys(t) for t in changed], [f[2] for _, f in pairs]
        mine, theirs = Tables(CELLS, own), Tables(CELLS, other)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d, _ in pairs], pa.int64()),
                pa.array([len(d[1]) for d, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(mine.texts([len(k) for k in own]), pa.string()),
                pa.array(theirs.texts([len(k) for k in other]), pa.string()),
                pa.array(likenesses(own, other, mine, theirs), pa.float64()),
                pa.array(likenesses(own, ahead, mine), pa.float64()),
            ],
            names=["id", *_NAMES],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # id, text, keys, block
        done = False  # the held block has met its extra row
        for batch in batches:
            for part in slices(batch, text_col):
                pairs = []
                for ident, text, block, extra in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    same = held is not None and held[3] == block
                    if done and same:
                        continue  # more rows that share the id of the next range's first
                    now = ident, text or "", keys(text or ""), block
                    if same:
                        pairs.append((held, now))
                    held, done = now, bool(extra)
                if pairs:
                    yield results(pairs)

    out = streams.mapInArrow(run, f"id long, {_SCHEMA}")
    return out.select(F.col("id").cast(kind).alias(id_col), *_NAMES)

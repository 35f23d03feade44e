"""Language identification with language-bitmask n-gram filters.

Training counts the byte 4-grams of every training text by language and keeps, per language, those that are frequent
there. They go into one bit-sliced Bloom filter: a slot holds a bit per language, so the slots of a gram, ANDed,
give all languages that contain it. A text is judged by the popcount of every language over its grams, corrected
for the grams that the filter would let through by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import releasing, small_batches, table
from tessella.llm.textkernel import chunks

#: Most grams of a language, share of the best language's rate that a gram must reach.
GRAMS, SHARE = 32_768, 0.1
#: Languages of a word; a slot has as many words as all languages need.
WORD_BITS = 64
SLOT_BITS, HASHES = 20, 3
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte 4-grams of each row, of folded text between single blanks, and their rows."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes + 2)
    text = np.full(len(data) + 2 * n, 32, np.uint8)
    text[np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1] = _FOLD[data]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
    text, row = text[keep].astype(np.uint32), row[keep]
    if len(text) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    key = text[:-3] | text[1:-2] << np.uint32(8) | text[2:-1] << np.uint32(16) | text[3:] << np.uint32(24)
    own = row[:-3] == row[3:]
    return key[own], row[:-3][own]


class Filters:
    """A bit-sliced Bloom filter over the grams of every language."""

    def __init__(self, languages: list[str], members: list[tuple[np.ndarray, int]]):
        self.languages = languages
        self.slots = np.zeros((-(-len(languages) // WORD_BITS), 1 << SLOT_BITS), np.uint64)
        for gram, language in members:
            word, bit = self._bit(language)
            for at in self._at(gram.astype(np.uint64)):
                self.slots[word, at] |= bit
        fill = [np.count_nonzero(self.slots[word] & bit) / (1 << SLOT_BITS) for word, bit in map(self._bit, range(len(languages)))]
        self.chance = np.array([f**HASHES for f in fill])

    @staticmethod
    def _bit(language: int) -> tuple[int, np.uint64]:
        return language // WORD_BITS, np.uint64(1) << np.uint64(language % WORD_BITS)

    @staticmethod
    def _at(gram: np.ndarray) -> list[np.ndarray]:
        return [(gram * f >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for f in FACTORS]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of the grams of each row that each language contains, and the number of grams."""
        key, row = grams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(row, minlength=n)
        first, second, third = self._at(key.astype(np.uint64))
        share = np.zeros((n, len(self.languages)))
        for word, slots in enumerate(self.slots):
            masks = slots[first] & slots[second] & slots[third]
            for k in range(word * WORD_BITS, min((word + 1) * WORD_BITS, len(self.languages))):
                hits = np.bincount(row, weights=(masks >> np.uint64(k % WORD_BITS) & np.uint64(1)).astype(float), minlength=n)
                share[:, k] = np.clip((hits - total * self.chance[k]) / np.maximum(total, 1) / (1 - self.chance[k]), 0, 1)
        return share, total


def fit(labelled: DataFrame) -> Filters:
    """Filters from all rows of ``labelled`` (text, lang); rows with a null in either are passed over.

    Every language takes part. What reaches the driver is at most GRAMS packed grams of each.
    """
    small_batches(labelled.sparkSession)

    def count(batches):
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for low, high, data, offsets in chunks(batch.column(0)):
                key, row = grams(data, offsets)
                names = sorted(set(languages[low:high]))
                code = np.array([names.index(x) for x in languages[low:high]])[row] if len(row) else row
                for k, name in enumerate(names):
                    g, n = np.unique(key[code == k], return_counts=True)
                    if name in seen:
                        both = np.concatenate([seen[name][0], g])
                        g, back = np.unique(both, return_inverse=True)
                        n = np.bincount(back, weights=np.concatenate([seen[name][1], n]), minlength=len(g)).astype(np.int64)
                    seen[name] = g, n
        for name, (g, n) in seen.items():
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = labelled.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(releasing(count), "lang string, gram long, n long")
    counts = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    if not languages:
        counts.unpersist()
        return Filters([], [])
    top = (
        counts.join(F.broadcast(totals), "lang")
        .withColumn("rate", F.col("n") / F.col("total"))
        .withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
        .filter(F.col("rate") >= SHARE * F.col("best"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .filter(F.col("place") <= GRAMS)
    )

    def packed(batches):
        for batch in batches:
            names, gram = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy().astype(np.uint32)
            own = sorted(set(names))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([gram[names == x].tobytes() for x in own], pa.binary())], ["lang", "grams"])

    number = {x: k for k, x in enumerate(languages)}
    got = top.select("lang", "gram").mapInArrow(releasing(packed), "lang string, grams binary").collect()
    members = [(np.frombuffer(r["grams"], np.uint32), number[r["lang"]]) for r in got]
    counts.unpersist()
    return Filters(languages, members)


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``coverage``.

    ``coverage`` is the corrected share of the grams that the chosen language contains, ``score`` that share over the
    sum for all languages. The first language by name wins ties. A null text, or one without letters, is ``und`` with
    score 0, as is every text if nothing was learned. Columns with the names of results are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "coverage")
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            languages, scores, coverage = [], [], []
            for low, _, data, offsets in chunks(texts):
                ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 128))])
                lettered = np.diff(ascii_letter[offsets]) > 0
                for k in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                    lettered[k] = any(c.isalpha() for c in texts[low + int(k)].as_py())
                if not filters.languages:
                    lettered[:] = False
                share, _ = filters.judge(data, offsets)
                best = share.argmax(axis=1) if filters.languages else np.zeros(len(lettered), int)
                top = share.max(axis=1, initial=0)
                languages += [filters.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores.append(np.where(lettered, top / np.maximum(share.sum(axis=1), 1e-12), 0.0))
                coverage.append(np.where(lettered, top, 0.0))
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64())
            columns = [*(batch.column(c) for c in names), pa.array(languages, pa.string()), join(scores), join(coverage)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "coverage"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{kinds}, lang_pred string, score double, coverage double")


def held_out():
    """Whether a row is kept from training; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.filter(~held_out()).select("text", "lang"))
    return identified(docs.select("doc_id", held_out().alias("held_out"), "text"), filters).select(
        "doc_id", "held_out", "lang_pred", "score", "coverage"
    )

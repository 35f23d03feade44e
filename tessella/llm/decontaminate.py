"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ``WINDOW`` consecutive words (one window of all its words if it has fewer).
A document contains a window only if it contains every shingle of it, so under containment 1.0 the prefix
that must be joined is a single shingle: the one that is rarest over all documents. Candidate places then pass a
length and position bound (the window must fit inside the document around the shingle) and are verified word by
word.

A benchmark of at most ``BLOCK_BYTES`` characters is an index in every worker, and nothing is shuffled but counts. A
larger one is never gathered: its shingles are counted, ordered and joined with those of the documents by Spark, and a
bitmap of fixed size keeps all other shingles of the documents out of the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import releasing, small_batches, table, use_checkpoints
from tessella.llm.textkernel import ALNUM, Words, chunks, raw, sequence_hash

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 16 << 20
FILTER_BITS = 18
#: Bits of the bitmap of a larger benchmark, as a power of two: at most 2 ** (BITMAP - 6) rows of one long reach the driver.
BITMAP = 24


class Index:
    """The windows of one block of items, by the hash of one shingle of each."""

    def __init__(self, item_ids: list[str], texts: list[str | None]):
        words = Words(*raw(pa.array(texts, pa.string())), ALNUM, lower=True)
        self.hashes = words.hashes
        self.items = item_ids
        begin, size, item = [], [], []
        for k, n in enumerate(words.counts):
            length = min(int(n), WINDOW)
            for at in range(int(n) - length + 1 if n else 0):
                begin.append(words.first[k] + at)
                size.append(length)
                item.append(k)
        self.begin, self.size, self.item = (np.array(x, np.int64) for x in (begin, size, item))
        self.text = [b" ".join(words.word(b + j) for j in range(s)) for b, s in zip(begin, size, strict=True)]
        self.sizes = sorted({min(SHINGLE, s) for s in size})
        #: All shingles of all windows: which window, at which offset, and the hash.
        owner, offset, key = [], [], []
        for s in self.sizes:
            of = np.flatnonzero(np.minimum(self.size, SHINGLE) == s)
            for j in range(WINDOW - s + 1):
                fits = of[self.size[of] >= j + s]
                owner.append(fits)
                offset.append(np.full(len(fits), j))
                key.append(sequence_hash(self.hashes, self.begin[fits] + j, s))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.owner, self.offset, self.key = join(owner, np.int64), join(offset, np.int64), join(key, np.uint64)
        self._fix(np.unique(self.key))

    def _fix(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions whose shingle is one of ``keys``, and its index there."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in self.sizes:
            h, pos = words.windows(s)
            near = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            k = np.searchsorted(self.keys, h[near])
            k[k == len(self.keys)] = 0
            good = self.keys[k] == h[near] if len(self.keys) else np.zeros(len(near), bool)
            at.append(pos[near[good]])
            which.append(k[good])
        return np.concatenate(at), np.concatenate(which)

    def keep_rarest(self, frequency: dict[int, int]) -> None:
        """Keep one shingle of each window: the rarest in the documents, the leftmost of equals."""
        count = np.array([frequency.get(int(k), 0) for k in self.keys.view(np.int64)], np.int64)
        order = np.lexsort((self.offset, count[np.searchsorted(self.keys, self.key)], self.owner))
        first = order[np.unique(self.owner[order], return_index=True)[1]]
        first = first[np.argsort(self.key[first], kind="stable")]
        self.owner, self.offset, key = self.owner[first], self.offset[first], self.key[first]
        self._fix(np.unique(key))
        self.low, self.high = np.searchsorted(key, self.keys, "left"), np.searchsorted(key, self.keys, "right")

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence of a window."""
        at, which = self.find(words)
        if not len(at):
            return at, at
        n = self.high[which] - self.low[which]
        at = np.repeat(at, n)
        entry = np.repeat(self.low[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = self.owner[entry]
        start = at - self.offset[entry]
        row = np.searchsorted(words.first, at, "right") - 1
        fits = (start >= words.first[row]) & (start + self.size[window] <= words.first[row + 1])
        window, start = window[fits], start[fits]
        for j in range(WINDOW):  # word by word, only where all words so far agree
            more = self.size[window] > j
            ok = np.ones(len(window), bool)
            ok[more] = words.hashes[start[more] + j] == self.hashes[self.begin[window[more]] + j]
            window, start = window[ok], start[ok]
        same = [
            b" ".join(words.word(s + j) for j in range(self.size[w])) == self.text[w] for w, s in zip(window, start, strict=True)
        ]
        return window[same], start[same]


def _frequencies(docs: DataFrame, index: Index) -> dict[int, int]:
    """How often each shingle of the block occurs, over all documents."""

    def count(batches):
        total = np.zeros(len(index.keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(index.find(Words(data, offsets, ALNUM, lower=True))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index.keys[seen].view(np.int64)), pa.array(total[seen])], ["key", "n"])

    rows = docs.select("text").mapInArrow(releasing(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: r["n"] for r in rows}


def _scan(docs: DataFrame, index: Index, names: list[str]) -> DataFrame:
    """Add the hit words and the items of one block to what earlier blocks found."""

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            hits = batch.column("hits").to_pylist()
            items = batch.column("items").to_pylist()
            counts = np.zeros(batch.num_rows, np.int64)
            for low, high, data, offsets in chunks(texts):
                words = Words(data, offsets, ALNUM, lower=True)
                counts[low:high] = words.counts
                window, start = index.matches(words)
                if not len(window):
                    continue
                row = np.searchsorted(words.first, start, "right") - 1
                for r in np.unique(row):
                    own = row == r
                    marked = np.zeros(words.counts[r], bool)
                    marked[hits[low + r]] = True
                    for s, n in zip(start[own] - words.first[r], index.size[window[own]], strict=True):
                        marked[s : s + n] = True
                    hits[low + r] = np.flatnonzero(marked).tolist()
                    items[low + r] = sorted({*items[low + r], *(index.items[k] for k in np.unique(index.item[window[own]]) if index.items[k] is not None)})
            done = {"hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(counts)}
            yield pa.RecordBatch.from_arrays([done[c] if c in done else batch.column(c) for c in names], names)

    schema = docs.schema
    return docs.mapInArrow(releasing(scan), schema)


def _windows(bench: DataFrame) -> DataFrame:
    """(item_id, words, shingles) of every window; a shingle is (offset, key)."""

    def run(batches):
        for batch in batches:
            for low, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, ALNUM, lower=True)
                spelled = [words.word(i).decode() for i in range(len(words.hashes))]
                for r, n in enumerate(words.counts.tolist()):
                    if not n:
                        continue
                    size, first = min(n, WINDOW), int(words.first[r])
                    part = min(size, SHINGLE)
                    keys = sequence_hash(words.hashes, np.arange(first, first + n - part + 1), part).view(np.int64).tolist()
                    item = batch.column("item_id")[low + r].as_py()
                    for at in range(0, n - size + 1, 4096):
                        starts = range(at, min(at + 4096, n - size + 1))
                        listed = [[{"offset": j, "key": keys[k + j]} for j in range(size - part + 1)] for k in starts]
                        columns = [
                            pa.array([item] * len(starts), pa.string()),
                            pa.array([spelled[first + k : first + k + size] for k in starts], pa.list_(pa.string())),
                            pa.array(listed, pa.list_(pa.struct([("offset", pa.int32()), ("key", pa.int64())]))),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "shingles"])

    return bench.mapInArrow(releasing(run), "item_id string, words array<string>, shingles array<struct<offset:int,key:long>>")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which values of the BITMAP highest bits occur among the keys."""
    place = F.shiftrightunsigned("key", 64 - BITMAP)
    bits = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bits).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _shingles_in(words: Words, sizes: list[int], bitmap: np.ndarray):
    """(key, first word) of the shingles that the bitmap holds."""
    for s in sizes:
        h, at = words.windows(s)
        near = bitmap[(h >> np.uint64(64 - BITMAP)).astype(np.int64)] > 0
        yield h[near], at[near], s


def _counted(docs: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """(key, n): how often shingles in the bitmap occur in the documents."""

    def run(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in chunks(batch.column(0)):
                found += [h for h, _, _ in _shingles_in(Words(data, offsets, ALNUM, lower=True), sizes, bitmap)]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.select("text").mapInArrow(releasing(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """(own, at, key, left, around): shingles of the documents in the bitmap, with the words that a window may cover."""

    def run(batches):
        for batch in batches:
            own = batch.column("own")
            for low, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, ALNUM, lower=True)
                for h, at, s in _shingles_in(words, sizes, bitmap):
                    row = np.searchsorted(words.first, at, "right") - 1
                    for i in range(0, len(at), 4096):
                        k, r = at[i : i + 4096], row[i : i + 4096]
                        begin, end = np.maximum(words.first[r], k - WINDOW + 1), np.minimum(words.first[r + 1], k + s + WINDOW - 1)
                        around = [[words.word(j).decode() for j in range(b, e)] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
                        columns = [
                            own.take(pa.array(low + r)), pa.array((k - words.first[r]).astype(np.int32)), pa.array(h[i : i + 4096].view(np.int64)),
                            pa.array((k - begin).astype(np.int32)), pa.array(around, pa.list_(pa.string())),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["own", "at", "key", "left", "around"])

    return docs.mapInArrow(releasing(run), "own struct<a:long,b:long>, at int, key long, left int, around array<string>")


def _joined(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` with ``hits`` and ``items`` by joins alone."""
    use_checkpoints(docs.sparkSession)
    windows = _windows(bench).groupBy("words", "shingles").agg(F.collect_set("item_id").alias("item_ids")).checkpoint()
    windows = windows.withColumn("window", F.xxhash64("words"))
    each = windows.select("window", "words", F.explode("shingles").alias("s")).select("window", "words", "s.*")
    sizes = [r["n"] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]
    counts = _counted(docs, sizes, _bitmap(each))
    # The prefix of a window: its rarest shingle that occurs; a window with one that does not occur has no match.
    known = each.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = known.groupBy("window", "words").agg(F.min(F.struct("n", "offset", "key")).alias("p")).filter("p.n > 0")
    prefix = prefix.select("words", "p.key", "p.offset").checkpoint()
    own = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    key = F.struct(F.xxhash64(*own, F.lit(1)).alias("a"), F.xxhash64(*own, F.lit(2)).alias("b"))
    places = _places(docs.select(key.alias("own"), F.coalesce("text", F.lit("")).alias("text")), sizes, _bitmap(prefix))
    size, start = F.size("words"), F.col("left") - F.col("offset")
    found = places.join(prefix, "key").filter((start >= 0) & (start + size <= F.size("around")))
    found = found.filter(F.slice("around", F.greatest(start, F.lit(0)) + 1, size) == F.col("words")).select("own", (F.col("at") - F.col("offset")).alias("start"), "words").distinct()
    found = found.join(windows.select("words", "item_ids"), "words")
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + size - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
    found = found.groupBy("own").agg(covered.alias("_dc_hits"), items.alias("_dc_items"))
    joined = docs.withColumn("_dc_own", key).join(found, F.col("_dc_own") == F.col("own"), "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return joined.select(*docs.columns, F.coalesce("_dc_hits", none("int")).alias("hits"), F.coalesce("_dc_items", none("string")).alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``hits`` (0-based positions of words inside a benchmark window) and
    ``items`` (ids, as strings, of the items with such windows, sorted).

    A null text has no words; an item without words has no window and is never found; the windows of an item without
    an id hit words, but no id is listed for it; repeated rows of an item count as one item and repeated documents are
    each judged; an empty benchmark marks nothing. Columns of ``docs`` that bear the names of the results are replaced,
    and other columns pass through.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "hits", "items")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BLOCK_BYTES:
        rows = bench.collect()
        index = Index([r["item_id"] for r in rows], [r["text"] for r in rows])
        index.keep_rarest(_frequencies(docs, index))
        found = docs.withColumns({"hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    else:
        index = Index([], [])
        index.keep_rarest({})
        found = _joined(docs, bench)
    found = found.select(*docs.columns, F.lit(0).cast("long").alias("n_words"), "hits", "items")
    return _scan(found, index, found.columns)


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM low),
long AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n FROM word
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
item AS (SELECT DISTINCT item_id::VARCHAR AS item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
part AS (SELECT item_id, words, unnest(range(greatest(len(words) - 9, 1))) AS k FROM item WHERE len(words) > 0),
windowed AS (SELECT DISTINCT item_id, array_to_string(list_slice(words, k + 1, k + 10), ' ') AS run, least(len(words), 10) AS size, words[k + 1] AS first FROM part),
match AS (
  SELECT doc_id, pos, size, item_id FROM long JOIN windowed USING (run) WHERE size = 10 AND n = 10
  UNION ALL
  SELECT l.doc_id, l.pos, w.size, w.item_id FROM long l JOIN windowed w ON w.size < 10 AND l.word = w.first JOIN low ON low.doc_id = l.doc_id
  WHERE array_to_string(list_slice(low.words, l.pos + 1, l.pos + w.size), ' ') = w.run),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM match) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM match WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )

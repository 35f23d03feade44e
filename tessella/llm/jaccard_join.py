"""Near-duplicate documents: an n-gram Jaccard join with Bayesian candidate pruning.

1. Documents with the same words in the same order form one class, represented once; copies are never compared.
2. A representative's distinct word 5-grams give ``BANDS * ROWS`` MinHash values. Representatives that agree on a
   band meet in a bucket. At similarity 0.8 a pair misses all buckets with probability below 4e-8. Each bucket links its
   members to its least one; a connected component of these links holds all buckets of its texts.
3. A component that fits in a block is one unit of work: each of its texts is sent once, however many buckets it is in.
   A larger one is compared in whichever way sends fewer rows: as a whole, or bucket by bucket, where a pair belongs to
   the first band that it shares. So texts that merely hang together in a long chain are never all compared, and those
   that are all alike are not sent once a band. A unit beyond the size of a block is dealt to blocks, and each pair of
   blocks is a task's work.
   Inside a unit MinHash values are compared ``STEP`` at a time, and pairs go as soon as the posterior probability
   (uniform prior) that their similarity reaches the threshold is below ``EPSILON``. The rest is verified exactly on the
   5-gram sets. A unit returns a row per document: its number of links and the least member it is connected with. Pairs
   are never shuffled.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import releasing, small_batches, table, use_checkpoints
from tessella.llm.components import components
from tessella.llm.textkernel import NOT_BLANK, Words, chunks, mixed, sequence_hash

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, STEP, EPSILON = 24, 3, 8, 1e-6
#: Most documents and 5-grams of a block, on average over the blocks of a unit.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 512, 2_000_000
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-grams of each row, in order, and the first of each row; a shorter text is one shingle."""
    h, at = words.windows(size)
    row = np.searchsorted(words.first, at, "right") - 1
    for n in range(1, size):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            h = np.concatenate([h, sequence_hash(words.hashes, words.first[short], n)])
            row = np.concatenate([row, short])
    order = np.argsort(row, kind="stable")
    return h[order], np.searchsorted(row[order], np.arange(len(words.counts) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each row that has shingles, as rows of uint32; zeros for the others."""
    out = np.zeros((len(first) - 1, len(_FACTORS)), np.uint32)
    full = np.flatnonzero(np.diff(first))
    k = 0
    while k < len(full):  # runs of rows that stay in the processor's cache
        j = max(k + 1, int(np.searchsorted(first[full + 1], first[full[k]] + 65_536)))
        part = h[first[full[k]] : first[full[j - 1] + 1]]
        starts = first[full[k:j]] - first[full[k]]
        scratch = np.empty_like(part)
        for f, factor in enumerate(_FACTORS):
            np.multiply(part, factor, out=scratch)
            out[full[k:j], f] = np.minimum.reduceat(scratch, starts) >> np.uint64(32)
        k = j
    return out


def _described(docs: DataFrame) -> DataFrame:
    """doc_id with two hashes of the word sequence, the number of words and the MinHash values (binary)."""

    def run(batches):
        for batch in batches:
            parts = []
            for low, high, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, NOT_BLANK)
                k1, k2 = (sequence_hash(words.hashes, words.first[:-1], words.counts, salt) for salt in (1, 2))
                sig = signatures(*shingles(words))
                parts.append((k1.view(np.int64), k2.view(np.int64), words.counts, [s.tobytes() for s in sig]))
            k1, k2, n, sig = ([x for p in parts for x in p[c]] for c in range(4))
            columns = [batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_words", "sig"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, k1 long, k2 long, n_words long, sig binary")


def keyed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``_k1`` and ``_k2``, hashes of the word sequence; null for a text without words."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            keys: tuple[list, list] = [], []
            for _, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, NOT_BLANK)
                for salt, k in enumerate(keys, 1):
                    k += pa.array(sequence_hash(words.hashes, words.first[:-1], words.counts, salt).view(np.int64), mask=words.counts == 0).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(k, pa.int64()) for k in keys)], [*names, "_k1", "_k2"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{kinds}, _k1 long, _k2 long")


def namesakes(keys: DataFrame) -> DataFrame | None:
    """(k1, k2) of texts whose first hash another text, of a lesser second hash, has too; None if there are none."""
    least = keys.groupBy("k1").agg(F.min("k2").alias("least"), F.max("k2").alias("most")).filter("least < most").checkpoint()
    if not least.limit(1).count():
        return None
    return keys.join(least, "k1").filter("k2 > least").select("k1", "k2").distinct()


def noded(rows: DataFrame, twice: DataFrame | None) -> DataFrame:
    """``rows`` with ``node``, one long for each pair (k1, k2): k1 itself, or a hash of both for ``namesakes``."""
    if twice is None:
        return rows.withColumn("node", F.col("k1"))
    rows = rows.join(twice.withColumn("_twice", F.lit(True)), ["k1", "k2"], "left")
    return rows.withColumn("node", F.when(F.col("_twice"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("_twice")


def _once(texts: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text) without the repeats of a batch and, where doc_id is null, of a task."""
    names = ["doc_id", "k1", "k2"]

    def run(batches):
        seen: set = set()
        for batch in batches:
            keep = []
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if key not in seen:
                    seen.add(key)
                    keep.append(at)
            seen = {key for key in seen if key[0] is None}
            yield batch.take(pa.array(keep, pa.int64()))

    return texts.select(*names, "text").mapInArrow(releasing(run), "doc_id long, k1 long, k2 long, text string")


def _sets(texts: DataFrame) -> DataFrame:
    """node and its sorted distinct shingles (binary) from (node, text)."""

    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in chunks(batch.column(1)):
                h, first = shingles(Words(data, offsets, NOT_BLANK))
                out += [np.unique(h[first[r] : first[r + 1]]).tobytes() for r in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "grams"])

    return texts.mapInArrow(releasing(run), "node long, grams binary")


def least_matches(similarity: float) -> list[tuple[int, int]]:
    """(values compared, fewest that must agree) at each step of the pruning."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, 0
        while True:  # P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= EPSILON:
                break
            m += 1
        out.append((n, m))
    return out


def linked(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) of similar sets, each pair once; with a band those that share it first."""
    same = left is right
    alive = np.triu(np.ones((len(left), len(left)), bool), 1) if same else np.ones((len(left), len(right)), bool)
    for b in range(band + 1):
        agreed = np.ones(alive.shape, bool)
        for f in range(b * ROWS, (b + 1) * ROWS):
            agreed &= sig[left, f][:, None] == sig[right, f][None, :]
        alive &= agreed if b == band else ~agreed
    agree = np.zeros(alive.shape, np.int16)
    done = 0
    a, b = np.nonzero(alive)
    for n, least in least_matches(similarity):
        if 8 * len(a) > alive.size:
            for f in range(done, n):
                agree += sig[left, f][:, None] == sig[right, f][None, :]
            a, b = np.nonzero(alive & (agree >= least))
        else:
            agree[a, b] += (sig[left[a], done:n] == sig[right[b], done:n]).sum(axis=1, dtype=np.int16)
            keep = agree[a, b] >= least
            a, b = a[keep], b[keep]
        alive[:] = False
        alive[a, b] = True
        done = n
        if not len(a):
            return left[a], right[b]
    size = np.array([len(s) for s in sets])
    if len(a) < 2000:
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left[a], right[b], strict=True)])
    else:
        inter = _products(sets, left, right)[a, b]
    total = size[left[a]] + size[right[b]] - inter
    good = inter >= similarity * total - 1e-9
    return left[a[good]], right[b[good]]


def _products(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, as sums of matrix products over slices of the shared shingles."""
    use = left if left is right else np.concatenate([left, right])
    flat = np.concatenate([sets[i] for i in use])
    row = np.repeat(np.arange(len(use)), [len(sets[i]) for i in use])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for low in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [low, low + width])
        matrix = np.zeros((len(use), width), np.float32)
        matrix[row[i:j], column[i:j] - low] = 1
        x = matrix[: len(left)]
        total += x @ (x if left is right else matrix[len(left) :]).T
    return np.rint(total).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cut, cut[1:], strict=False):
            key = tuple(k[:, low])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _verified(units: DataFrame, similarity: float) -> DataFrame:
    """(node, peer, n_links) of each unit of work: links of the node there, and the least node it is connected with."""
    kinds = "node long, peer long, n_links long"

    def run(batches):
        for group in _groups(batches, ["unit", "band", "i", "j"]):
            node, block = group["node"].to_numpy(), group["block"].to_numpy()
            if len(node) < 2:
                continue
            sig = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in group["sig"]])
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["grams"]]
            i, j, band = (group[c][0].as_py() for c in ("i", "j", "band"))
            left = np.flatnonzero(block == i)
            a, b = linked(sig, sets, left, left if i == j else np.flatnonzero(block == j), similarity, band)
            if not len(a):
                continue
            links = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
            least = node.copy()
            while True:  # the least node in reach
                before = least.copy()
                np.minimum.at(least, a, before[b])
                np.minimum.at(least, b, before[a])
                if (before == least).all():
                    break
            got = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(least[got]), pa.array(links[got].astype(np.int64))], ["node", "peer", "n_links"])

    return units.mapInArrow(releasing(run), kinds)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links), a row for each row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of word 5-grams is at least ``similarity``; a text of
    fewer words is one gram of all its words. class_id is the least doc_id of the connected component, n_links the number
    of different texts (word sequences) linked to the text, n_copies the number of rows with its word sequence, itself
    included. A text without words, or null, is a class of its own with its doc_id. A null doc_id is kept and never
    names a class unless no row of the class has another. Repeated rows are copies of each other.
    """
    return classified(docs, similarity).drop("k1", "k2", "root")


def _blocks(n, shingles):
    return F.ceil(F.greatest(n / BLOCK_DOCUMENTS, shingles / BLOCK_SHINGLES)).cast("int")


def _bands(sig):
    """(band, hash of its values) of each band of a signature."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring(sig, b * ROWS * 4 + 1, ROWS * 4)).alias("value")) for b in range(BANDS)])


def units(member: DataFrame) -> DataFrame:
    """(unit, band, node, sig, grams, blocks) from (root, node, sig, grams): who is compared with whom, by whole components
    (band -1) or, where that sends fewer rows, by the buckets of a large component.

    Everything is decided on narrow rows; signatures and sets are moved once, when each text has the list of its units.
    """
    narrow = member.select("root", "node", F.octet_length("grams").alias("size"), "sig")
    size = narrow.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("size") / 8).alias("s")).select("root", "n", _blocks(F.col("n"), F.col("s")).alias("blocks")).checkpoint()
    whole = narrow.select("root", "node").join(size, "root")
    alone = F.array(F.struct(F.col("root").alias("unit"), F.lit(-1).alias("band"), "blocks")).alias("units")
    large = size.filter("blocks > 1")
    if not large.limit(1).count():
        listed = whole.select("node", alone)
    else:
        met = narrow.join(large, "root").select("root", (F.col("n") * F.col("blocks")).alias("sent"), "node", "size", F.explode(_bands("sig")).alias("b")).checkpoint()
        buckets = met.groupBy("root", "sent", "b").agg(F.count("*").alias("in"), F.sum(F.col("size") / 8).alias("s")).filter("`in` > 1")
        buckets = buckets.select("root", "sent", F.xxhash64("root", "b").alias("unit"), "b", "in", _blocks(F.col("in"), F.col("s")).alias("blocks")).checkpoint()
        apart = buckets.groupBy("root", "sent").agg(F.sum(F.col("in") * F.col("blocks")).alias("rows")).filter("rows < sent").select("root").checkpoint()
        sent = met.join(apart, "root", "left_semi").select("node", "root", "b").join(buckets.select("root", "b", "unit", "blocks"), ["root", "b"])
        sent = sent.groupBy("node").agg(F.collect_list(F.struct("unit", F.col("b.band").alias("band"), "blocks")).alias("units"))
        listed = whole.join(apart, "root", "left_anti").select("node", alone).unionByName(sent)
    moved = member.select("node", "sig", "grams").join(listed, "node").select("node", "sig", "grams", F.explode("units").alias("u"))
    return moved.select("u.unit", "u.band", "node", "sig", "grams", "u.blocks")


def classified(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``classes`` with the two hashes of the text and the key of its class; null for a text without words."""
    use_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = _described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).checkpoint()
    twice = namesakes(rows.filter("n_words > 0").select("k1", "k2"))
    rows = noded(rows, twice)
    texts = rows.filter("n_words > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.min("sig").alias("sig"))
    banded = texts.select("node", F.explode(_bands("sig")).alias("b")).select("node", "b.value")
    hubs = banded.groupBy("value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("value", "hub")
    edges = banded.join(hubs, "value").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().checkpoint()
    roots = components(edges)

    # The text of every candidate from the first row that bears it; an id may be null or shared by other texts.
    wanted = roots.join(texts.select("node", "sig", F.col("first").alias("doc_id")), "node")
    source = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumnsRenamed({"_k1": "k1", "_k2": "k2"})
    source = noded(_once(source), twice)
    some = source.join(wanted.select("node", "doc_id"), (source["node"] == wanted["node"]) & source["doc_id"].eqNullSafe(wanted["doc_id"])).select(source["node"], "text")
    grams = _sets(some).groupBy("node").agg(F.max("grams").alias("grams"))
    member = wanted.select("node", "root", "sig").join(grams, "node").checkpoint()
    dealt = units(member).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "unit", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "sig", "grams"
    )
    dealt = dealt.repartition("unit", "band", "i", "j").sortWithinPartitions("unit", "band", "i", "j")
    links = _verified(dealt, similarity).checkpoint()
    joined = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = texts.select("node", "first", "n_copies").join(joined, "node", "left").join(counts, "node", "left")
    named = known.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("class_id"))
    known = known.withColumn("root", F.coalesce("root", "node")).join(named, "root").select("node", "root", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = lambda c: F.when(F.col("n_words") > 0, F.col(c)).alias(c)
    return rows.select("doc_id", own("k1"), own("k2"), own("node")).join(known, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "k1",
        "k2",
        "root",
    )


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))

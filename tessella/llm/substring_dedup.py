"""Repeated passages by compaction of a de Bruijn graph of word k-mers.

A window of ``WINDOW`` words is an edge from its first to its last ``WINDOW - 1`` words. Only edges that stand in texts
of several documents matter, so the graph is built in two steps that lose none of them:

1. Each window is known by its minimizer, the least hash of its ``ANCHOR``-word grams. Equal windows have equal
   minimizers, and neighbouring windows mostly share theirs, so a fifth of the rows tells which texts can hold a
   repeated window at all. Texts with the same words throughout are one text, standing in its least doc_id.
2. Windows with a repeated minimizer become edge rows. Edges meet by hash; each gets its source (the least
   document, and the place there) and whether its ends branch.
   What a batch of rows can tell by itself is settled there, so a passage that stands in very many documents sends a
   row or two per batch to the shuffle.

Occurrences after the source document are repeats. Along a document, consecutive repeats whose common node does not
branch form one path, and a path is a span as long as its source coordinates run on with its own; so a long span is
verified against the source at each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import releasing, small_batches, table, use_checkpoints
from tessella.llm.textkernel import NOT_BLANK, Words, chunks, mixed, sequence_hash

WINDOW, ANCHOR = 13, 5


def text_key(words: Words) -> np.ndarray:
    """A hash of the whole word sequence of each row."""
    return sequence_hash(words.hashes, words.first[:-1], words.counts, salt=3).view(np.int64)


def minimizers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, first word) of every window."""
    n = len(words.hashes)
    at = np.flatnonzero(np.arange(n) <= np.repeat(words.first[1:], words.counts) - WINDOW)
    if not len(at):
        return np.zeros(0, np.int64), at
    least = sequence_hash(words.hashes, np.arange(n - ANCHOR + 1), ANCHOR, salt=5)
    want, have = WINDOW - ANCHOR + 1, 1
    while have < want:  # least of the grams from each place on, of twice as many each time
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least[at].view(np.int64), at


def _keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text key, words) of every row."""

    def run(batches):
        for batch in batches:
            key, n = [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, NOT_BLANK)
                key.append(text_key(words))
                n.append(words.counts)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), join(key), join(n)], ["doc_id", "key", "n"])

    return docs.mapInArrow(releasing(run), "doc_id long, key long, n long")


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, key, known): the minimizers of each text.

    Within a batch, an anchor of more than two texts sends only two of them to the shuffle, which suffice to tell that
    it is shared; for the others that is known, and they carry the anchor as ``known`` and go by their text key.
    """

    def run(batches):
        for batch in batches:
            anchors, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in chunks(batch.column(0)):
                words = Words(data, offsets, NOT_BLANK)
                least, at = minimizers(words)
                row = np.searchsorted(words.first, at, "right") - 1
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                anchors.append(least[new])
                keys.append(text_key(words)[row[new]])
            anchor, key = np.concatenate(anchors), np.concatenate(keys)
            order = np.lexsort((key, anchor))
            a, k = anchor[order], key[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
            order, a = order[new], a[new]
            known = np.zeros(len(anchor), bool)
            known[order[2:]] = a[2:] == a[:-2]
            chosen = np.sort(order)  # in order of the texts, which compresses well
            anchor, key, known = anchor[chosen], key[chosen], known[chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(known, key, anchor)), pa.array(key), pa.array(anchor, mask=~known)], ["anchor", "key", "known"]
            )

    return docs.select("text").mapInArrow(releasing(run), "anchor long, key long, known long")


#: The words beside a window, by seven bits of their hash: what stands for none, and for several.
NONE, DIFFER = 128, 129
#: Bits of an edge row's second long, from below: place in the text, the word after, the word before, more of the hash.
POS_BITS, SIDE_BITS = 28, 8


def _edges(texts: DataFrame) -> DataFrame:
    """Edge rows of (doc_id, text, key, anchors): the windows whose minimizer is among the anchors.

    Within a batch, only the occurrences of a window in the least document there meet those of other batches. The rest
    are repeats of it for certain: they carry their source and go by their text key.
    """
    kinds = "h long, aux long, doc_id long, key long, source long, place int"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches):
        for batch in batches:
            doc, key, anchors = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy(), batch.column("anchors")
            parts = []
            for low, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, NOT_BLANK)
                own = text_key(words)
                least, at = minimizers(words)
                row = np.searchsorted(words.first, at, "right") - 1
                keep = np.zeros(len(at), bool)
                edge = np.searchsorted(row, np.arange(len(words.counts) + 1))
                for r in range(len(words.counts)):
                    i, j = edge[r], edge[r + 1]
                    if j > i and own[r] == key[low + r]:
                        keep[i:j] = np.isin(least[i:j], anchors[low + r].values.to_numpy())
                at, row = at[keep], row[keep]
                if not len(at):
                    continue
                check = (sequence_hash(words.hashes, at, WINDOW, salt=11) >> np.uint64(45)).astype(np.int64)
                small = (words.hashes >> np.uint64(57)).astype(np.int64)
                first, last = words.first[row], words.first[row + 1] - WINDOW
                before = np.where(at == first, NONE, small[at - 1])
                after = np.where(at == last, NONE, small[np.minimum(at + WINDOW, len(small) - 1)])
                parts.append((sequence_hash(words.hashes, at, WINDOW).view(np.int64), check, doc[low + row], own[row], at - first, before, after))
            if not parts:
                continue
            h, check, ids, own, pos, before, after = (np.concatenate([p[c] for p in parts]) for c in range(7))
            order = np.lexsort((pos, ids, check, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            source, place = ids[order][begin][group], pos[order][begin][group]
            known = ids > source
            for side in (before, after):
                high, low = np.maximum.reduceat(side[order], begin), np.minimum.reduceat(side[order], begin)
                side[(high != low)[group]] = DIFFER
            aux = ((check << SIDE_BITS | before) << SIDE_BITS | after) << POS_BITS | pos
            columns = [pa.array(np.where(known, own, h)), *map(pa.array, (aux, ids, own)), pa.array(source, mask=~known), pa.array(place.astype(np.int32), mask=~known)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("doc_id", "text", "key", "anchors").mapInArrow(releasing(run), kinds)


def _spans(repeat: list[dict] | None) -> list[tuple[int, int, int, int]]:
    """(start, end, source, place there) of the compacted paths of one document's repeated windows, by start.

    A window's code holds its place here, its place in the source, and whether it joins the one before and goes on.
    """
    out: list[list[int]] = []
    open_end = False
    for code, source in sorted((x["code"], x["source"]) for x in repeat or []):
        pos, place, joins = code >> 33, code >> 2 & 0x7FFFFFFF, code & 2
        if out and open_end and joins and out[-1][1] == pos + WINDOW - 1 and out[-1][2] == source and out[-1][3] + pos - out[-1][0] == place:
            out[-1][1] += 1
        else:
            out.append([pos, pos + WINDOW, source, place])
        open_end = code & 1
    return [tuple(s) for s in out]


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_removed``, ``spans`` and ``kept``.

    A word goes if a window over it also starts in a document with a smaller doc_id, judged on the input. ``spans``
    lists the repeated paths (start, end exclusive, source doc_id, first word there), ``kept`` the words left, joined
    by one space. Which of several earlier documents is named as a source may depend on how rows are dealt; the words that
    go do not. A null text has no words. Rows with a null doc_id neither lose words nor make others lose them.
    Rows that share a doc_id do not repeat each other, whether their texts differ or not. Columns with the names of
    results are replaced, others pass through.
    """
    use_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "spans", "kept")
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("_td_id"), "*")
    named = rows.select("_td_id", "text").filter("_td_id is not null")
    keys = _keys(named).distinct().checkpoint()
    first = keys.filter(F.col("n") >= WINDOW).groupBy("key").agg(F.min("doc_id").alias("first"))

    # One shuffle by anchor and one by edge; a batch sends few rows of either, so no group is large.
    anchors = _anchors(named).withColumn("shared", F.col("known").isNotNull() | (F.min("key").over(Window.partitionBy("anchor")) < F.max("key").over(Window.partitionBy("anchor"))))
    listed = anchors.filter("shared").select("key", F.coalesce("known", "anchor").alias("anchor"))
    lists = listed.groupBy("key").agg(F.collect_set("anchor").alias("anchors")).join(first, "key").select(F.col("first").alias("_td_id"), "key", "anchors")

    # Dealt by hash alone; the rest of the hash only parts what stands in a partition. Two longs keep a row narrow.
    edges = _edges(named.join(lists, "_td_id").withColumnRenamed("_td_id", "doc_id")).repartition("h")
    bits = lambda low, n: F.shiftright("aux", low).bitwiseAND(F.lit((1 << n) - 1))
    certain = F.col("source").isNotNull()
    check = F.when(certain, F.lit(-1).cast("long")).otherwise(F.shiftright("aux", POS_BITS + 2 * SIDE_BITS))
    edges = edges.withColumns({"check": check, "before": bits(POS_BITS + SIDE_BITS, SIDE_BITS), "after": bits(POS_BITS, SIDE_BITS), "pos": bits(0, POS_BITS)})
    edge = Window.partitionBy("h", "check")
    one = lambda side: (F.min(side).over(edge) == F.max(side).over(edge)) & (F.min(side).over(edge) != DIFFER)
    edges = edges.withColumns({"least": F.min(F.struct("doc_id", "pos")).over(edge), "joins": one("before"), "goes_on": one("after")})
    joins, goes_on = F.when(certain, F.col("before") != DIFFER).otherwise(F.col("joins")), F.when(certain, F.col("after") != DIFFER).otherwise(F.col("goes_on"))
    place = F.coalesce(F.col("place").cast("long"), "least.pos")
    code = F.shiftleft("pos", 33).bitwiseOR(F.shiftleft(place, 2)).bitwiseOR(joins.cast("long") * 2 + goes_on.cast("long"))
    repeats = edges.filter(certain | (F.col("doc_id") > F.col("least.doc_id"))).select("doc_id", "key", code.alias("code"), F.coalesce("source", "least.doc_id").alias("source"))
    repeats = repeats.groupBy("doc_id", "key").agg(F.collect_list(F.struct("code", "source")).alias("repeat"))

    info = keys.join(first, "key", "left").join(repeats, ["doc_id", "key"], "left")
    facts = info.groupBy(F.col("doc_id").alias("_td_id")).agg(F.collect_list(F.when((F.col("first") < F.col("doc_id")) | F.col("repeat").isNotNull(), F.struct("key", "first", "repeat"))).alias("_td_facts"))
    joined = rows.join(facts, "_td_id")
    if docs.filter("doc_id is null").limit(1).count():
        joined = joined.unionByName(rows.filter("_td_id is null"), allowMissingColumns=True)
    joined = joined.select(*(F.col("_td_id").alias(c) if c == "doc_id" and docs.schema[c].dataType.simpleString() == "bigint" else F.col(c) for c in names), "_td_facts")

    def run(batches):
        for batch in batches:
            facts = batch.column("_td_facts")
            texts = batch.column("text")
            n_words, n_removed, spans, kept = [], [], [], []
            for low, high, data, offsets in chunks(texts):
                words = Words(data, offsets, NOT_BLANK)
                own = text_key(words)
                for r in range(high - low):
                    n = int(words.counts[r])
                    parts = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    found = []
                    for fact in facts[low + r].as_py() or ():
                        if fact["key"] == own[r] and n >= WINDOW:
                            copy = fact["first"] < batch.column("doc_id")[low + r].as_py()
                            found = [(0, n, fact["first"], 0)] if copy else _spans(fact["repeat"])
                    gone = np.zeros(n, bool)
                    for s in found:
                        gone[s[0] : s[1]] = True
                    if found:
                        parts = [parts[i] for i in np.flatnonzero(~gone)]
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    spans.append([dict(zip(("start", "end", "source", "place"), s, strict=True)) for s in found])
                    kept.append(b" ".join(parts).decode())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))
            columns = [*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "spans", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(releasing(run), f"{kinds}, n_words long, n_removed long, spans array<struct<start:int,end:int,source:long,place:int>>, kept string")


SQL = r"""
WITH word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
long AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n FROM word
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
first AS (SELECT run, min(doc_id) AS first FROM long WHERE n = 13 GROUP BY run),
judged AS (
  SELECT l.doc_id, l.pos, l.word, max(CASE WHEN f.first < l.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS 12 PRECEDING) = 1 AS gone
  FROM long l LEFT JOIN first f ON l.n = 13 AND l.run = f.run),
total AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN total USING (doc_id)
"""


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    got = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

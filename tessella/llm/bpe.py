"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for a pre-token. A sequence of tokens is what the merge rules give exactly if
every adjacent pair is compatible, that is, if no merge across the seam would have come before the merges that
built the two sides; all pairs of a batch are tested at once. Only pre-tokens with a failing pair are merged step
by step. Pre-tokens that a worker has met before come from a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import releasing, small_batches, table

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker keeps, in two generations; longer ones than KEEP_CHARS are never kept.
KEEP, KEEP_CHARS = 200_000, 64
#: Characters of text that are taken together, unless one text alone is longer.
TOGETHER = 1 << 19
#: Words of more bytes are merged with a heap; below, scanning a short list is faster.
SHORT = 48
NONE = np.int64(1 << 40)
#: Stands between words in one string of bytes; no piece holds it.
BETWEEN = "\u0100"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plane_pattern() -> re.Pattern:
    r"""PRE_TOKEN for texts of the basic plane, where ``re`` looks a character up in a table.

    Letters come first, which changes nothing: no other alternative starts with one.
    """
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = lambda p: "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(p, every))
    letter, digit = ranges(r"\p{L}+"), ranges(r"\p{N}+")
    return re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{digit}]+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: to_bytes(s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        #: Finds the longest piece at each place of a string that holds bytes as its code points.
        self.pieces_found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.pieces_found.add_word(piece.decode("latin-1"), i)
        self.pieces_found.add_word(BETWEEN, -1)
        self.pieces_found.make_automaton()
        self.pre_token, self.plane_token = regex.compile(PRE_TOKEN), plane_pattern()
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        size = max(self.pieces) + 1
        #: Per token: the rank of the merge that makes it (-1 for a byte) and its two parts.
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            merge[a, b] = rank, made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        self.rank_of = {a << 32 | b: r for (a, b), (r, _) in merge.items()}
        self.made = {r: m for r, m in merge.values()}
        keys = np.array([a * size + b for a, b in merge], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array([r for r, _ in merge.values()], np.int64)[order]
        #: Ids of pre-tokens, joined by commas, and the decoded text of those few that do not come back as they were.
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.judged: dict[int, bool] = {}

    # -- verification ---------------------------------------------------------------------------------------

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when their bytes are merged together.

        The merges that built both sides are undone, latest first (on equal ranks the right one, as merging goes from
        the left). At each seam on the way, a merge across it that comes before the merge undone last would have been
        taken instead.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        # A merge across the seam beats the merge undone last if its rank is lower, or equal and it stands further left.
        limit = np.full(len(a), NONE)
        while len(live):
            x, y = a[live], b[live]
            bad = self._pair_rank(x, y) * 2 + 1 < limit[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            of_left = rx > ry
            a[live] = np.where(of_left, self.right[x], x)
            b[live] = np.where(of_left, y, self.left[y])
            limit[live] = np.where(of_left, rx * 2, ry * 2 + 2)
        return good

    # -- encoding -------------------------------------------------------------------------------------------

    def propose(self, words: list[bytes]) -> np.ndarray:
        """Greedy longest match over all words at once: token ids, with -1 after each word."""
        text = BETWEEN.join([w.decode("latin-1") for w in words]) + BETWEEN
        return np.fromiter((i for _, i in self.pieces_found.iter_long(text)), np.int64)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        if len(word) > SHORT:
            return self._merged_long(word)
        ids, rank, made, last = self.byte_ids, self.rank_of.get, self.made, 1 << 40
        token = [ids[b] for b in word]
        ranks = [rank(a << 32 | b, last) for a, b in zip(token, token[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == last:
                break
            k = ranks.index(least)
            token[k : k + 2] = (made[least],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank(token[k - 1] << 32 | token[k], last)
            if k < len(ranks):
                ranks[k] = rank(token[k] << 32 | token[k + 1], last)
        return token

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap of candidate pairs over a linked list: n log n for a word of n bytes."""
        import heapq

        token = [self.byte_ids[b] for b in word]
        after, before = [*range(1, len(token)), -1], [*range(-1, len(token) - 1)]
        ranked = lambda a, b: self.rank_of.get(a << 32 | b, -1)
        heap = [(m, k, token[k], token[k + 1]) for k in range(len(token) - 1) if (m := ranked(token[k], token[k + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if token[k] != a or j < 0 or token[j] != b:
                continue
            token[k], token[j], after[k] = self.made[rank], -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (m := ranked(token[p], token[q])) >= 0:
                    heapq.heappush(heap, (m, p, token[p], token[q]))
        return [t for t in token if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Add pre-tokens to the table, each decoded from its ids and compared."""
        raw = [w.encode() for w in words]
        flat = self.propose(raw)
        ends = np.flatnonzero(flat < 0)
        seam = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        key, back = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
        verdict = np.array([self.judged.get(k, -1) for k in key.tolist()], np.int8)
        new = np.flatnonzero(verdict < 0)
        verdict[new] = self.compatible(key[new] // self.size, key[new] % self.size)
        if len(self.judged) + len(new) > KEEP:
            self.judged.clear()
        self.judged.update(zip(key[new].tolist(), verdict[new].tolist(), strict=True))
        failed = np.zeros(len(words), bool)
        failed[np.searchsorted(ends, seam[verdict[back] == 0])] = True
        proposed, at, pieces = flat.tolist(), 0, self.pieces
        for w, b, end, bad in zip(words, raw, ends.tolist(), failed.tolist(), strict=True):
            ids = self.merged(b) if bad else proposed[at:end]
            at = end + 1
            self.known[w] = ",".join(map(str, ids))
            decoded = b"".join([pieces[i] for i in ids])
            if decoded != b:
                self.odd[w] = decoded.decode("utf-8", "replace")

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; the strings of special tokens are pre-tokens of their own."""
        plane = len(text.encode("utf-16-le")) == 2 * len(text)
        find = (self.plane_token if plane else self.pre_token).findall
        if self.specials is None or not any(s in text for s in self.special):
            return find(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + find(text[at:])

    def batch(self, texts: list[str | None]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, decoded text) of every text."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEEP // 2:  # what was met since the last change stays at hand, the rest goes
            before, known = self.before, self.known = known, {}
            new = list(words)
            self.odd = {w: d for w, d in self.odd.items() if w in before}
        unseen = []
        for w in new:
            if w in before:
                known[w] = before[w]
            elif w in self.special:
                known[w] = str(self.special[w])
            else:
                unseen.append(w)
        if unseen:
            self.learn(unseen)
        odd = self.odd
        for words in split:
            ids = ",".join([known[w] for w in words])
            decoded = "".join([odd.get(w, w) for w in words]) if odd else "".join(words)
            yield ids, ids.count(",") + 1 if words else 0, decoded
        for w in unseen:
            if len(w) > KEEP_CHARS:
                del known[w]
                odd.pop(w, None)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens``, ``ids`` (array of int, if asked for), ``ids_sha256`` and ``decoded``.

    ``path`` names the vocabulary file, which every executor must be able to open (None: the installed one). A null
    text counts as empty and has no ids. Strings of special tokens inside a text become those tokens, as the file
    declares; decoding keeps them. Columns with the names of results are replaced, others pass through; rows are
    handled one by one, so repeats and order do not matter.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded")
    names = docs.columns

    def run(batches):
        own = codec(path or default_vocabulary())
        for batch in batches:
            got = list(own.batch(batch.column("text").to_pylist()))
            columns = [batch.column(c) for c in names]
            columns.append(pa.array([g[1] for g in got], pa.int64()))
            columns.append(pa.array([hashlib.sha256(g[0].encode()).hexdigest() for g in got], pa.string()))
            columns.append(pa.array([g[2] for g in got], pa.string()))
            if ids:
                columns.append(pa.array([np.fromstring(g[0], np.int32, sep=",") for g in got], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded", *["ids"] * ids])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{kinds}, n_tokens long, ids_sha256 string, decoded string" + ", ids array<int>" * ids)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    got = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False)
    return got.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

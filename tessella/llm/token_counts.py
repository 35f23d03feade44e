"""Token counts under a unigram model, with one dynamic programme per shared prefix.

The distinct pre-tokens of a batch are inserted in a trie by sorting them: neighbours in sorted order share a path,
so the walk keeps the forward scores of the common prefix and only extends them by the letters that differ. Each
letter of the trie is scored once, and the terminal count of a pre-token is the number of pieces on its best path.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import releasing, small_batches, table

#: Pre-tokens whose counts a worker keeps; longer ones than KEEP_CHARS are never kept.
KEEP, KEEP_CHARS = 300_000, 64
MARK = "▁"


class Unigram:
    """A unigram model over the pieces of a vocabulary file.

    The files hold no unigram probabilities, so a piece of rank r (0 for the most frequent) gets Zipf's log
    probability, -log(r + 2). A letter that no piece covers costs as many pieces as it has bytes, each scored below
    every piece. Of paths with equal scores the one with fewer pieces counts.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.pieces = {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(sorted(kept, key=lambda i: -model.get_score(i)))}
        self.bytes_score = -math.log(len(kept) + 2) - 1
        self.longest = max(map(len, self.pieces))
        self.known: dict[str, int] = {}

    def count(self, words: list[str]) -> dict[str, int]:
        """Piece counts of distinct pre-tokens, through their trie."""
        out: dict[str, int] = {}
        best: list[tuple[float, int]] = [(0.0, 0)]  # forward score and minus the pieces, at each depth of the path
        path, pieces, longest = "", self.pieces, self.longest
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top = None
                for start in range(max(0, end - longest), end):
                    p = pieces.get(word[start:end])
                    if p is not None:
                        s, n = best[start]
                        if top is None or (s + p, n - 1) > top:
                            top = s + p, n - 1
                letter = word[end - 1]
                if letter not in pieces:
                    size = len(letter.encode("utf-8", "surrogatepass"))
                    s, n = best[end - 1]
                    other = s + size * self.bytes_score, n - size
                    if top is None or other > top:
                        top = other
                best.append(top)
            path = word
            out[word] = -best[-1][1]
        return out

    def batch(self, texts: list[str | None]) -> list[int]:
        words = [[MARK + w for w in (t or "").split()] for t in texts]
        known = self.known
        new = {w for own in words for w in own if w not in known}
        if len(known) + len(new) > KEEP:
            known.clear()
            new = {w for own in words for w in own}
        known.update(self.count(list(new)))
        out = [sum([known[w] for w in own]) for own in words]
        for w in new:
            if len(w) > KEEP_CHARS:
                del known[w]
        return out


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens``, the pieces of its whole text under the unigram model.

    Pre-tokens are the runs between white space, each with a leading mark. A null or blank text has 0. A column named
    ``n_tokens`` is replaced, others pass through; rows are counted one by one.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_tokens")
    names = docs.columns

    def run(batches):
        own = model(path or default_vocabulary())
        for batch in batches:
            got = pa.array(own.batch(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got], [*names, "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{kinds}, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")

"""A small corpus with every awkward case: nulls, blanks, repeats, copies, long texts and clashing columns."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; as columns of the input they must do no harm.
CLASHING = ["n_words", "n_removed", "hits", "items", "spans", "kept", "key", "id", "h", "root", "node", "class_id", "n_tokens", "ids", "score", "pii", "signature", "anchors", "first", "r1", "a", "b"]


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(1, 7))) for _ in range(n))


def rows() -> list[tuple]:
    r = random.Random(5)
    base = [sentence(r, n) for n in (1, 3, 4, 5, 12, 13, 14, 40, 60, 90, 200)]
    passage, notice = sentence(r, 30), "all rights reserved here"
    texts = [None, "", "   ", "\n\n", "***", "word", *base]
    texts += [base[7], base[7], base[8] + " end", base[8].replace(" ", "  "), f"{base[5]} {passage} {base[6]}", f"{passage} {base[4]}", f"x {passage}"]
    texts += [f"{sentence(r, 30)}\n{notice}\n{sentence(r, 5)}" for _ in range(14)] + [notice] * 3
    words = sentence(r, 60).split()
    for k in range(6):  # near copies of one text
        texts.append(" ".join(w if i != 7 * k else "changed" for i, w in enumerate(words)))
    texts += [sentence(r, 30_000), "z" * 150_000, "Ünïcode ÄÖ ßß ñandú élan 漢字 仮名 — tell +1 (555) 123-4567 or x.y@z.org"]
    out = [(k * 3 + 1, t, ["en", "fr", None][k % 3], f"s{k % 15}" if k % 9 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[10], out[10], (out[12][0], "another text under a used doc id " + base[9], "en", "s1", 3), (None, base[9], "en", "s2", 4), (None, None, None, None, None)]

"""The registered queries on a small folder of tables: their digest columns against plain Python."""

from __future__ import annotations

import zlib

import pytest
from awkward_rows import COLUMNS, rows
from test_corpus_operators import BENCH, bench_rows, classes_plainly, leaks_plainly, lines_plainly, passages_plainly, personal, sha

from tessella.llm import bpe, queries

PAGES = [(1, "u", "<body><article><p>one &amp; two</p></article><footer>f</footer></body>"), (2, "v", None), (3, "w", "")]


def documents() -> list[tuple]:
    seen: dict = {}
    for row in rows():
        if row[0] is not None and len(row[1] or "") < 20_000:
            seen.setdefault(row[0], row)
    return [seen[k] for k in sorted(seen)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("registered")
    spark.createDataFrame(documents(), COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench_rows(), BENCH).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def by_id(spark, folder, name, key="doc_id"):
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) == len({x[key] for x in got})
    return {x[key]: x for x in got}


def test_op1(spark, folder):
    got = by_id(spark, folder, "op1_pii")
    for d, t, *_ in documents():
        spans = personal(t)
        kinds = [kind for *_, kind in spans]
        assert [got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert got[d]["base_sha256"] == sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans))
        assert {f"{kind}:{a}:{b}" for a, _, b, kind in spans} <= set(got[d]["spans"].split(","))
    assert any(x["n_email"] for x in got.values())


def test_op2(spark, folder):
    got, order = by_id(spark, folder, "op2_order_minhash"), documents()[::-1]
    for (d, t, *_), (e, u, *_) in zip(order, [*order[1:], order[0]], strict=True):
        t, u, x = t or "", u or "", got[d]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == sha(t[: len(t) - len(t) // 2] + u[: len(t) // 2])
        same = [x["fingerprint"][k : k + 8] == got[e]["fingerprint"][k : k + 8] for k in range(0, 256, 8)]
        assert len(x["fingerprint"]) == 256 and x["near_next"] == sum(same) / 32 and 0 <= x["near_edited"] <= 1


def test_op3_and_op4(spark, folder):
    got = by_id(spark, folder, "op3_line_dedup")
    for d, n, wide, gone, kept in lines_plainly(documents(), 10):
        assert (got[d]["n_lines"], got[d]["n_boilerplate"], got[d]["n_removed"], got[d]["kept_sha256"]) == (n, wide, gone, sha(kept))
    got = by_id(spark, folder, "op4_substring_dedup")
    for d, n, gone, kept in passages_plainly(documents()):
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (n, gone, sha(kept))


def test_op5(spark, folder):
    got = by_id(spark, folder, "op5_html_text", "page_id")
    assert {k: (x["url"], x["text"], x["n_chars"]) for k, x in got.items()} == {1: ("u", "one & two", 9), 2: ("v", "", 0), 3: ("w", "", 0)}


def test_op6(spark, folder):
    got = by_id(spark, folder, "op6_jaccard_join")
    assert [tuple(got[d]) for d, *_ in documents()] == list(classes_plainly(documents()))


def test_op7(spark, folder):
    got = by_id(spark, folder, "op7_language_id")
    for d, t, *_ in documents():
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d]["score"] <= 1
        assert got[d]["lang_pred"] in (("en", "fr") if any(c.isalpha() for c in t or "") else ("und",))


def test_op8_and_op9(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    got = by_id(spark, folder, "op8_bpe")
    for d, t, *_ in documents():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want
    assert len(by_id(spark, folder, "op9_token_counts")) == len(documents())


def test_op10(spark, folder):
    got = by_id(spark, folder, "op10_decontaminate")
    for d, n, hit, items in leaks_plainly(documents(), bench_rows()):
        x = got[d]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == (n, len(hit), len(items), sha(",".join(items)), bool(hit))
    assert any(x["contaminated"] for x in got.values())

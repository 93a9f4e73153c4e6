import re

import public_tokenizers
import tiktoken
from edge import edge_docs, empty_docs, prose
from test_decontaminate import brute as contamination
from test_jaccard import brute as groups

import corpus_pipeline as p
from popweave.llm import bpe, pii_rules

SF = "/root/testdata/sf0.001"


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if re.search(r"[^\W\d_]", r["text"]))
    kept = {d for (_, d), _, c in groups(rows, 5, 4, 5) if d == c}
    kept = {d: t for d, t in rows if d in kept}
    for d, t in list(kept.items()):
        n, hit, *_ = contamination(t, items)
        if hit and 20 * hit >= n:
            del kept[d]
    got = by_id(p.run(spark, SF))
    assert set(got) == set(kept)
    own = bpe.Bpe.read(public_tokenizers.path(p.VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for d, t in kept.items():
        spans = pii_rules.find(t)
        text = own.decode(got[d]["ids"]).decode()
        assert got[d]["n_tokens"] == len(got[d]["ids"]) and got[d]["ids"] == library.encode_ordinary(text)
        if not re.search("[0-9@]", t):
            assert text == t
        for a, b, _ in spans:
            assert t[a:b] not in text


def test_each_stage_stands_hard_rows(spark):
    docs = edge_docs(spark, ["1234 5678", "call +1 (555) 010-9999 now please"])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert stage(spark, empty_docs(spark), SF).count() == 0, name
        ids = {r["doc_id"] for r in rows}
        if name == "language_id":
            assert not ids & {0, 1, 2, 10} and {3, 4, 5, 6, 7, 9, 11, None} <= ids
        elif name == "near_duplicates":
            assert 6 not in ids and {0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, None} == ids and len(rows) == len(ids)
        elif name == "decontamination":
            assert len(rows) == docs.count()
        else:
            assert len(rows) == docs.count() and "[PHONE]" in by_id(out)[11]["text"]
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert p.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(i, prose(60, i), "en", "s", None) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_near_duplicates_judge_rows(spark):
    a, b = prose(60, 41), prose(60, 42)
    rows = [(3, a), (3, a + " tail"), (5, a.upper()), (5, b), (5, b), (7, b + " end"), (8, prose(30, 43))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, SF).collect())
    assert [g[0] for g in got] == [3, 5, 8] and got[1] == (5, b) and got[0][1] in (a, a + " tail")

"""Every query over the smallest tables, against SQL or brute force."""

import hashlib
import os
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken

from test_jaccard import brute as groups
from test_licenses import base as phrases
from test_pii import brute as personal

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402
from popweave.llm import bpe, pii  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, key):
    return {r["doc_id"]: r for r in entry.queries()[key](spark, SF).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_are_registered():
    keys = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert keys == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("key", ["op2_chat_formatting", "op8_benchmark_decontamination", "op9_exact_top_k", "op11_conversation_prefix_trie", "op12_conversation_repair", "op13_line_dedup"])
def test_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = rows_of(entry.queries()[key](spark, SF).toArrow()), rows_of(con.execute(entry.oracle_sql()[key]).to_arrow_table())
    assert got[0] == want[0] and got[1] == want[1] and got[2] == want[2]


def test_op1(spark, docs):
    got = sorted(((False, d), r["n_shingles"], r["component_id"]) for d, r in result(spark, "op1_ngram_jaccard_join").items())
    assert got == groups(sorted(docs.items()), 4, 85, 100)


def test_op3(spark, docs):
    for d, r in result(spark, "op3_pii").items():
        spans = personal(docs[d])
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == n for s in spans) for n in range(4)]
        assert r["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(r["spans"].split(","))  | {""}


def test_op4(spark, docs):
    own = bpe.Bpe.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for d, r in result(spark, "op4_byte_bpe").items():
        ids = library.encode_ordinary(docs[d])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(docs[d]))


def test_op6(spark, docs):
    for d, r in result(spark, "op6_license_scans").items():
        n, count, first, last, labels = phrases(docs[d])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, count, first, last, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1

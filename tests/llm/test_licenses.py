import re

from edge import edge_docs, empty_docs, prose
from popweave.llm import licenses as m
from popweave.llm.text import lower_ascii

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w, places = WORD.findall(lower_ascii(text)), []
    for phrase, label in m.PHRASES.items():
        q = phrase.split()
        places += [(i, label) for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def test_phrases_against_brute_force(spark):
    docs = edge_docs(spark, [
        "MIT License", "the mit license, Apache\nLicense and CC-BY cc by", "gnu general public license gnu general public",
        f"{prose(50, 1)} gnu general public license {prose(3, 2)} MIT.License", "licensed under the apache license version 2.0"])
    got = sorted(((r["key"] is None, r["key"]), tuple(r)[1:6]) for r in m.scan_licenses(docs).collect())
    want = sorted(((r["doc_id"] is None, r["doc_id"]), base(r["text"])) for r in docs.collect())
    assert [(a, (*b[:4], list(b[4]))) for a, b in got] == want


def test_long_matches_chain_over_small_edits(spark):
    text = dict(m.TEMPLATES[::-1])["mit"]
    words = text.split()
    edited = " ".join(words[:9] + ["indeed"] + words[10:])
    docs = spark.createDataFrame([(1, f"{prose(20, 1)} {edited} {prose(20, 2)}"), (2, " ".join(words[:6])), (3, prose(500, 3))], "doc_id long, text string")
    rows = {r["key"]: r for r in m.scan_licenses(docs).collect()}
    assert rows[1]["labels"] == ["mit"] and rows[1]["base_labels"] == []
    span = rows[1]["spans"][0]
    assert (span["start"], span["end"]) == (20, 20 + len(words)) and 0.9 < span["coverage"] < 1
    assert rows[2]["labels"] == [] and 0 < rows[2]["score"] < m.COVERAGE
    assert rows[3]["score"] == 0 and rows[3]["spans"] == []


def test_empty(spark):
    assert m.scan_licenses(empty_docs(spark)).count() == 0

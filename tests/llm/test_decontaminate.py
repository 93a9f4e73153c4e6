import random
import re

from edge import edge_docs, empty_docs, prose
from popweave.llm import decontaminate as d
from popweave.llm.text import lower_ascii

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    w = WORD.findall(lower_ascii(text))
    hit, found = set(), set()
    for name, item in items:
        v = WORD.findall(lower_ascii(item))
        n = min(13, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), len(found), sorted(found)


def test_against_brute_force(spark):
    r = random.Random(4)
    items = [(i, prose(r.choice([1, 2, 5, 12, 13, 14, 40]), 100 + i)) for i in range(20)] + [(30, None), (31, ""), (32, prose(20, 7)), (33, prose(20, 7)), (34, "..")]
    items = [x for x in items if x[1] is None or len(x[1].split()) > 2 or x[0] % 2]
    texts = [prose(20, i) + " ; " + (x[1] or "").upper() + " " + prose(5, i) for i, x in enumerate(items)] + [prose(400, 9)]
    docs = edge_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["key"] is None, x["key"], x["n_words"], x["n_hit"], x["n_items"], x["items"]) for x in d.mark_contamination(docs, bench).collect())
    want = sorted((x["doc_id"] is None, x["doc_id"], *brute(x["text"], items)) for x in docs.collect())
    assert [g[2:] for g in got] == [w[2:] for w in want]
    kept = d.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not (w[3] > 0 and 20 * w[3] >= w[2]) for w in want)


def test_items_without_an_id_hit(spark):
    lost, known = prose(20, 70), prose(20, 71)
    bench = spark.createDataFrame([(None, lost), (None, prose(15, 72)), (3, known)], "item_id long, text string")
    docs = spark.createDataFrame([(1, lost), (2, f"{lost} . {prose(15, 72)} . {known}"), (3, "nothing here")], "doc_id long, text string")
    got = sorted((r["key"], r["n_hit"], r["n_items"], r["items"]) for r in d.mark_contamination(docs, bench).collect())
    assert got == [(1, 20, 1, [None]), (2, 55, 2, ["3", None]), (3, 0, 0, [])]
    assert [r["doc_id"] for r in d.remove_contaminated(docs, bench).collect()] == [3]


def test_empty_tables_and_shards(spark, monkeypatch):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = edge_docs(spark)
    assert d.mark_contamination(empty_docs(spark), none).count() == 0
    assert d.mark_contamination(docs, none).where("n_hit > 0 or n_items > 0").count() == 0
    items = [(i, prose(15, 50 + i)) for i in range(9)]
    docs = spark.createDataFrame([(i, f"{prose(9, i)} . {t}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.mark_contamination(docs, bench).select("key", "n_hit", "n_items").collect()))
    monkeypatch.setattr(d, "SHARD_BYTES", 100)
    assert len(d.item_shards(bench, "item_id", "text")) > 3
    assert whole == sorted(map(tuple, d.mark_contamination(docs, bench).select("key", "n_hit", "n_items").collect()))

import random
import re

import numpy as np
import pytest

from edge import edge_docs, empty_docs, prose
from popweave.llm import pii as m
from popweave.llm import pii_rules as rules

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * c, 10)) if k % 2 else c
    return total % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for x in re.finditer(p, text):
            d = re.sub("[^0-9]", "", x[0])
            if k == 0 or k == 1 and all(int(v) <= 255 for v in x[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((x.start(), x.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


TEXTS = ["mail a.b@c-d.org, a@b@c.de x@.y @q.z", "é 10.0.0.255 1.2.3.256 1.2.3.4.5.6.7.8 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "+1 (555) 010-9999. +12 +1234567890123456", "ünï 🙂 a@b.cc +49 30 1234567", "4444 3333 2222 1111@x.yz"]


def test_rules_against_the_patterns():
    r = random.Random(2)
    for text in TEXTS + ["".join(r.choice("a.1@+-() 25%4\né") for _ in range(r.randint(0, 45))) for _ in range(4000)]:
        assert rules.find(text) == brute(text)


def test_rules_take_linear_time():
    for text in ("a" * 300000, "1" * 300000, "1." * 150000, "a@" * 100000, "+1" * 100000, "1 " * 150000):
        rules.find(text)


def numeric(tagger, x, y, key, at, eps=1e-5):
    tagger.p[key][at] += eps
    high, _ = tagger.loss(x, y)
    tagger.p[key][at] -= 2 * eps
    low, _ = tagger.loss(x, y)
    tagger.p[key][at] += eps
    return (high - low) / (2 * eps)


def test_gradients():
    r = np.random.default_rng(1)
    tagger = m.Tagger(hidden=3)
    x, y = r.integers(0, m.N_CLASSES, (4, 7)), r.integers(0, m.TAGS, (4, 7))
    _, g = tagger.loss(x, y)
    for key, p in tagger.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in p.shape) if not key.startswith("in_") else (int(x[0, 0]), int(r.integers(0, p.shape[1])))
            assert abs(numeric(tagger, x, y, key, at) - g[key][at]) < 1e-5


def test_paths_against_all_paths():
    r = np.random.default_rng(2)
    tagger = m.Tagger(hidden=2)
    tagger.p["trans"] = r.normal(size=(m.TAGS, m.TAGS))
    tagger.compact()
    stretches = [r.normal(size=(n, m.TAGS)).astype(np.float32) for n in (1, 3, 2, 4)]
    for e, path in zip(stretches, tagger.paths(stretches)):
        every = np.array(np.meshgrid(*[range(m.TAGS)] * len(e), indexing="ij")).reshape(len(e), -1).T
        total = e[np.arange(len(e)), every].sum(axis=1) + tagger.p["trans"][every[:, :-1], every[:, 1:]].sum(axis=1)
        assert np.isclose(total[(every == path).all(axis=1)][0], total.max(), atol=1e-4)


@pytest.fixture(scope="module")
def tagger():
    r = random.Random(6)
    x, y = [], []
    for k in range(120):
        text = " ".join([prose(8, k), "".join(r.choice("abc") for _ in range(5)) + "@mail.example.com", prose(8, k + 500)])
        for a, b in m.labelled_windows(text, k):
            x.append(a)
            y.append(b)
    out = m.Tagger()
    out.train(np.array(x), np.array(y), steps=120)
    return out.compact()


def test_training_finds_spans_and_windows_agree(tagger):
    text = prose(40, 900) + " bca@mail.example.com " + prose(200, 901)
    at = text.index("bca@")
    found = m.tag_spans([text, "", prose(300, 3)], tagger)
    assert found[1] == found[2] == [] and any(a <= at + 3 and b >= at + 10 and k == 0 for a, b, k in found[0])
    assert m.tag_spans([text], tagger)[0] == found[0]


def test_base_spans_stay():
    assert m.merged([(3, 9, 0), (5, 7, 1)], [(0, 4, 2), (8, 12, 2), (9, 12, 2), (0, 3, 3)]) == [(0, 3, 3), (3, 9, 0), (5, 7, 1), (9, 12, 2)]
    assert m.masked("0123456789", [(1, 4, 0), (2, 5, 1), (8, 9, 3)]) == "0[EMAIL]567[PHONE]9"


def test_frames(spark, tagger):
    docs = edge_docs(spark, TEXTS + ["7" * 5000])
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, brute(r["text"] or "")) for r in docs.collect())
    rows = m.find_spans(docs, tagger).collect()
    got = sorted((r["key"] is None, r["key"] or 0, [(s["start"], s["end"], m.KINDS.index(s["kind"])) for s in r["base"]]) for r in rows)
    assert got == want
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in rows)
    clean = m.redact(docs, tagger)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any(brute(r["text"] or "") for r in clean.where("doc_id < 15").collect())
    assert clean.where("text is null").count() == docs.where("text is null").count()
    assert m.find_spans(empty_docs(spark), m.fit(empty_docs(spark))).count() == 0

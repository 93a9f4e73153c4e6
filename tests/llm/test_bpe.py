import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from edge import edge_docs, empty_docs
from popweave.llm import bpe as m

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    own = m.Bpe.read(PATH, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_ids_and_round_trip(both):
    own, library = both
    r = random.Random(3)
    texts = ["".join(r.choice("aabehtionTHE  .,\n\t123é字🙂'sß---===") for _ in range(r.randint(0, 120))) for _ in range(500)]
    texts += ["", "<|endoftext|>", "a" * 7000, "=-" * 4000, "".join(r.choice("etaoin") for _ in range(9000)), "ab" * 33, " " * 500]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_short_and_long_pieces_merge_alike(both):
    own, _ = both
    r = random.Random(5)
    for _ in range(400):
        piece = bytes(r.choice(b"aeiounst \xc3\xa9") for _ in range(r.randint(2, 64)))
        assert own._merge_short(piece) == own._merge_long(piece)
        assert not any(own.buckets) and not any(own.low) and not any(own.middle)


def test_rank_queue():
    q = m.RankQueue()
    for rank in (70000, 3, 64, 4096, 3):
        q.add(rank, 1)
    seen = []
    while (rank := q.first()) >= 0:
        seen.append(rank)
        q.drop(rank)
    assert seen == [3, 64, 4096, 70000]


def test_frames(spark, both):
    _, library = both
    docs = edge_docs(spark)
    want = sorted((hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t in ((r["text"] or "") for r in docs.collect()) for ids in [library.encode_ordinary(t)])
    for with_ids in (False, True):
        rows = m.token_digests(docs, PATH, PATTERN, with_ids=with_ids).collect()
        assert sorted((r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) for r in rows) == want
    coded = m.decode(m.encode(docs, PATH, PATTERN, out="key"), PATH, PATTERN, ids_col="key", out="score")
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "score"]
    assert all(bytes(r["score"]) == (r["text"] or "").encode() for r in coded.collect())
    assert m.token_digests(empty_docs(spark), PATH, PATTERN).count() == 0

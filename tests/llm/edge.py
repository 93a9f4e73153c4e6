"""Small tables with the cases that every operator has to stand."""

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_docs(spark, texts=(), schema="doc_id long, text string, lang string, source string, n_chars long, score double, key string"):
    """Documents with nulls, empty, blank, very long, equal and repeated texts; with columns of clashing names."""
    base = [None, "", " \n\t ", "x", "word", prose(30, 1), prose(30, 1), prose(40000, 2), "z" * 120000, "Ünïcode ß 漢字 🙂   x", *texts]
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, float(i), "k") for i, t in enumerate(base)]
    rows += [rows[5], (None, prose(30, 3), None, None, None, None, None)]
    return spark.createDataFrame(rows, schema)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

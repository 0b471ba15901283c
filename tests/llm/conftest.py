import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "to", "re", "mi", "so", "ku", "lé"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    """Nulls in every column, empty, blank, tiny and very long texts, copies,
    near copies, shared passages, repeated rows."""
    shared = prose("shared", 70)
    base = prose("base", 120).split()
    near = [*base]
    near[60] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "one two three", prose(1, 40), prose(2, 200), prose(2, 200), " ".join(base), " ".join(near), " ".join(base).upper(),
        prose(3, 60) + " " + shared + " " + prose(4, 30), prose(5, 10) + "\n" + shared + " " + prose(6, 90), "word " * 400, prose(7, 30_000), "<|endoftext|> don't 'tis   ok\n\n x", "漢字 — “quotes” İstanbul ½²", "a b c d e f idiot idiot moron",
    ]
    out = [(k, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    out.append((None, prose(8, 50), None, None, None))
    out.append(out[6])
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above with columns whose names the operators use themselves."""
    clash = {c: F.lit(c) for c in ("id", "k", "key", "n", "rep", "ids", "score", "size", "shard", "row", "__id", "piece", "label", "hi")}
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns(clash)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")

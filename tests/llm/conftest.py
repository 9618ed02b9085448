import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WORDS = ["alpha", "Beta", "gamma", "délta", "épsilon", "zeta9", "the", "of", "and", "über", "Ünique", "x"]


def long_text(n, seed=1):
    state, out = seed, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 8 & 7] + ("" if state & 1 else str(state % 97)))
    return " ".join(out)


LONG = long_text(60_000)
#: Nulls, empty and very long texts, repeated rows, texts that differ by case only, near copies, an id with two texts.
EDGES = [
    (1, None), (2, ""), (3, "  \t\n"), (4, "one two three"), (5, "ONE two Three"), (6, "É É É É"), (7, "é é é é"),
    (8, LONG), (9, LONG), (10, LONG + " tail"), (11, "a"), (11, "a"), (12, "a b"), (12, "b a"), (None, "one two three"),
    (None, "one two three"), (None, None), (13, "word " * 5000), (14, "x" * 40_000), (15, "日本語 テキスト 🤯 \x00 end"),
    (16, "password = hunter22hunter and token:abc"), (17, "mail bob.smith@example.com or +1 (722) 555-6978 now"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with further columns whose names the operators also use inside."""
    rows = spark.createDataFrame([(i, t) for i, t in EDGES], "doc_id long, text string").repartition(3)
    extra = {n: F.lit("clash") for n in ("fp", "key", "root", "start", "kind", "ids", "lang", "base", "mask", "variant", "word", "toxic", "copies", "n", "row")}
    return rows.withColumns(extra)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def pairs(docs):
    """(doc_id, text) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

import pytest

from fleetscope.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows, with extra
    columns named like those that the operators use inside."""
    prepare(spark)

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            for name in ("block", "did", "tk", "fp", "key", "row", "digest", "p", "w", "topic", "_tokens"):
                df = df.selectExpr("*", f"doc_id as `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded pseudo-prose: prose(seed, words) -> text of short sentences."""
    import random
    vocabulary = [a + b for a in ("ta", "re", "mi", "so", "lu", "ne", "ko", "vi") for b in
                  ("n", "ra", "lis", "mo", "ter", "ba", "du", "fen", "gor", "hy", "pas", "que")]

    def make(seed, words=60):
        pick, out = random.Random(seed), []
        while sum(len(s.split()) for s in out) < words:
            out.append(" ".join(pick.choice(vocabulary) for _ in range(pick.randrange(5, 12))).capitalize() + ".")
        return " ".join(out)
    return make

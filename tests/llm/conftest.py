import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Edge cases: nulls, empty and long texts, copies, near copies, repeated ids."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), prose(2, 80), "", None, "   ", "one two three", "One TWO three", "four five", prose(3, 3000), "x", 'token = "24be64439e3e49cf46b2d7c90f36"', prose(2, 80) + " tail", "é漢字😀 \n\t ü  ", "a  b   c "]
    out = [(k, t) for k, t in enumerate(texts)]
    return out + [(None, base), (None, "lonely words of a row without an id at all"), (3, prose(2, 80)), (3, "other text for a repeated id, of more than five words")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with the columns of documents and others whose names clash."""
    data = [(i, t, "en" if k % 3 else None, f"src{k % 2}/p" if k % 5 else None, len(t or ""), k, "keep", 1.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, node long, keep string, evidence double")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)

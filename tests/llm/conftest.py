import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, did string, th string, id string, row string, spans string, score string, comp string, `a.b` string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, clashing column names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, "a b c"), (1, "a b c"), (1, "other words"), (2, None), (3, ""), (4, " \t\n "), (None, "a b c"), (None, None), (5, long), (6, long + " tail"), (7, "x"), (8, "É ß 漢字 🙂")]
    rows = [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, "d", "t", "i", "r", None, "s", "c", "dot") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, AWKWARD)


@pytest.fixture(scope="session")
def repetitive():
    """(doc_id, text): few different words, planted passages, periodic texts, copies."""
    rng = random.Random(3)
    passage = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 9, 30)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(["aé", "b", "cc", "d"]) for _ in range(rng.randrange(0, 40)))]
        for p in passage:
            if rng.random() < 0.4:
                parts.insert(rng.randrange(len(parts) + 1), p)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(60, "p q " * 150), (61, "z " * 200), (62, None), (63, ""), (64, rows[5][1]), (64, rows[5][1]), (None, rows[7][1])]
    return rows

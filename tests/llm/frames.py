"""Small inputs that hold every awkward case at once."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, place long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    base, other = prose(rng, 60), prose(rng, 80)
    edited = base.split()
    edited[30] = "changed"
    texts = [
        (1, base), (2, base), (2, base), (3, " ".join(edited)), (4, other + " " + base), (5, None), (6, ""), (7, " \n\t "),
        (8, "short"), (9, "two words"), (10, "a" * 5000), (11, "é日本 😀 " * 40), (12, prose(rng, 6000)), (13, "ab " * 200),
        (14, "line one here\nline one here\n\nline two"), (None, "text without a number " * 3), (None, None), (15, other),
        (16, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" mail a.b@c.example.org ip 10.2.3.4 card 4111 1111 1111 1111 call +1 (017) 555-7713'),
    ]
    return [(i, t, None if k % 3 else "en", "s", None, True, "x", k) for k, (i, t) in enumerate(texts)]


def frame(spark):
    """Nulls in every column, repeated rows, long and empty texts, columns whose names operators use themselves."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n: int = 0):
    return spark.createDataFrame([(k, int(k % 4 > 0), int(k % 5 == 0)) for k in range(n)] + [(None, None, None)], "doc_id long, quality int, toxic int")

"""Documents that every operator has to take: nulls, ties, repeats, clashing names, long texts."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    made = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(words)]
    return "".join(w + ("\n" if k % 17 == 16 else " ") for k, w in enumerate(made)).strip()


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, row, n_words): the last two are clashing names."""
    base = prose(1, 200)
    texts = [
        (1, base), (2, base), (2, base), (3, base.replace("alpha", "omega", 1)),
        (4, None), (5, ""), (6, " \n\t\r "), (7, "Word"), (8, "word"), (9, "two words"),
        (10, prose(2, 60)), (11, prose(2, 60) + " tail of it"), (12, prose(3, 20_000)),
        (13, "x" * 100_000), (14, "é" * 50 + "\n" + "日本語 " * 30), (None, prose(4, 80)),
        (15, "\n".join(["the same line of text, long enough to be compared"] * 40)),
        (16, "Spam!! " * 90), (17, "a*** b$$$ c### " * 40), (18, "\x00 \x01 zero\x00bytes " * 30),
        (19, prose(5, 100)), (19, prose(6, 100)),
    ]
    return [
        (doc_id, text, (None, "en", "de")[k % 3], (None, "src0", "src0", "src1")[k % 4], len(text or ""), f"r{k}", k)
        for k, (doc_id, text) in enumerate(texts)
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, n_words int"


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

"""Small tables for the tests of this folder."""

import random

AWKWARD = [
    None, "", " \t\n ", "one", "one two", "one two", "a b c", "A B C", "word " * 300, "tie tie tie tie", "né œ 𝔘 日本語 text", "x" * 5000,
    "\n\n\n", "* # $ | <>", "\x00 \x1f mixed \x7f controls",
]


def prose(n: int, seed: int = 1, least: int = 5, most: int = 200) -> list[str]:
    """Texts of words drawn unevenly from a small vocabulary."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    return [" ".join(rng.choices(vocab, weights, k=rng.randint(least, most))) for _ in range(n)]


def near_copies(n: int, seed: int = 2, edits: tuple[int, int] = (0, 12)) -> list[str]:
    """A text of 150 words and copies of it with some words changed."""
    rng = random.Random(seed)
    base = prose(1, seed, 150, 150)[0].split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        out.append(" ".join(words))
    return out


def documents(spark, texts, **more):
    """A documents table with ids from 0 and extra columns whose names operators use themselves."""
    rows = [
        (k, t, ["en", "fr", None][k % 3], ["a", "b", None, "c"][k % 4], None if t is None else len(t), k, "x", None)
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n long, kept string, row string"
    )

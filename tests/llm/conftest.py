"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

CLASHING = "kept string, keep_id string, score string, shard string, ids string, component_id string, n_words string, size string, text_crc32 string, start string, payload string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def words_text(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()) + str(rnd.randrange(40)) for _ in range(n))


def awkward_texts() -> list[tuple]:
    base, passage = words_text(1, 120), words_text(2, 70)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one two three"), (9, "one two three"), (10, "one"), (None, base), (None, None),
        (11, words_text(3, 40) + "\n" + passage + "\n" + words_text(4, 30)), (12, words_text(5, 55) + " " + passage), (13, passage + " " + words_text(6, 20)), (14, passage),
        (15, words_text(7, 30_000)), (16, "café naïve 中文 it's we'll <|endoftext|> '' 12½  x\r\n\r\ny "), (17, "a b c\x0bd\x1ce"), (18, "same " * 400), (19, "same " * 399), (16, "twice"), (16, "twice"), (20, "\U0001f600" * 30 + " end"),
    ]
    rnd = random.Random(9)
    for k in range(21, 60):
        words = near.copy()
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(50)}"
        out.append((k, " ".join(words)))
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en", None if k % 9 == 0 else "hot" if k % 3 else f"s{k % 5}", None, *(["x"] * CLASHING.count("string"))) for k, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def scanned(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    awkward.repartition(3).write.parquet(path)
    return spark.read.parquet(path)

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kind string, fp string, key string, rank int, batch binary"
WORDS = {
    "en": "the of and that with erthing onstion whened hathe ster reand thion".split(),
    "de": "der die und nicht mit schein ungkeit verlich heitung zu achten".split(),
    "fr": "le la les des une que pour dans eaux tion ment élever être".split(),
}


def sentence(r: random.Random, lang: str, n: int) -> str:
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def make_docs() -> list[tuple]:
    """Documents of three languages, with copies, near copies, nulls, ties, odd white space and a long text."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        text = sentence(r, lang, r.choice([5, 40, 200]))
        rows.append((i, text, lang, f"src{i % 5}"))
    rows += [(200 + i, rows[10][1], "de", "src0") for i in range(40)]
    rows += [(300 + i, rows[11][1] + f" x{i}", "fr", "src0") for i in range(20)]
    odd = ["", " ", "\t\n", "a  b\n\n c ", "  lead", "tail  ", "İß ÄÖ x\x85y", "1234 5678", "<|endoftext|> and <|endoftext|>", "don't I'll\n\nwe've", "日本語の文章です" * 30, "a" * 700, "ab" * 400, "!?" * 90, "é \U0001F600 ok"]
    rows += [(400 + i, text, None if i % 2 else "en", None if i % 3 == 0 else "odd") for i, text in enumerate(odd)]
    rows += [(500, None, "en", "src1"), (None, "the of and", "en", "src1"), (None, None, None, None), (7, rows[7][1], "de", "src2"), (7, rows[7][1], "de", "src2")]
    rows.append((600, sentence(r, "en", 30_000), "en", "src3"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(*row, len(row[1] or ""), 1, "k", "f", "y", 2, b"b") for row in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

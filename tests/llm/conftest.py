import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, fp string, v string, found string"
WORDS = ["the", "of", "and", "heron", "lantern", "quarry", "velvet", "mosaic", "Tundra", "orbit", "pebble", "cedar", "falcon", "ember", "glacier", "harvest", "ivory", "jungle", "kettle", "lagoon", "meadow", "nectar", "opal", "prairie", "quill", "river", "saffron", "timber", "umber", "valley", "willow", "zephyr", "café", "straße", "naïve"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2))) + rng.choice(["", "", "", ",", ".", ".\n", "!"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose, copies, near copies, shared passages, null and empty texts, a very long one, one null id and one repeated row."""
    rng = random.Random(5)
    texts: list[str | None] = [prose(rng, rng.randint(1, 220)) for _ in range(40)]
    passage = prose(rng, 70)
    texts += [texts[3]] * 9 + [texts[4].upper(), texts[4]]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 25)}" for _ in range(6)]
    edited = passage.split(" ")
    edited[30:31] = ["changed"]
    edited.insert(45, "inserted")
    texts += [f"{prose(rng, 20)} {' '.join(edited)} {prose(rng, 20)}"]
    texts += [None, "", "   ", "\n\t ", "x", "one two", "a  b   c\n\n d ", "'s it's  I'LL 12 345 ²½ é́", "word " * 300, "q" * 3000, "日本語テキスト 漢字", "<|endoftext|> plain"]
    texts += [prose(rng, 6000)]
    out = list(enumerate(texts))
    return [*out, (None, "no id at all"), (7, texts[7])]


def frame(spark, rows, parts=3):
    data = [(i, t, "en", "s", len(t or ""), -1, "k", "z", "f", "v", "w") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])

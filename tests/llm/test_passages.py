"""Passages that the anchors and seeds of substring dedup must not lose."""

import random

from quotewright.llm import substring

from .conftest import frame


def unique(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n))


def covered(found):
    out: dict[int, set] = {}
    for r in found.collect():
        out.setdefault(r.id, set()).update(range(r.start, r.end))
    return out


def test_long_runs_are_covered(spark):
    """Texts of period 1, 2, 3 and 5, longer than alignment reaches, and a run in an earlier text that is shorter."""
    rng = random.Random(3)
    rows = []
    for n, period in enumerate((1, 2, 3, 5)):
        run = " ".join([*unique(rng, period).split()] * (900 // period))
        rows += [(10 * n, f"{unique(rng, 30)} {run} {unique(rng, 30)}"), (10 * n + 1, f"{unique(rng, 40)} {run} {unique(rng, 20)}")]
    rows += [(90, f"{unique(rng, 20)} {'so ' * 60}{unique(rng, 20)}"), (91, f"{unique(rng, 20)} {'so ' * 500}{unique(rng, 20)}")]
    got = covered(substring.repeated_passages(frame(spark, rows)))
    for n in range(4):
        assert set(range(40, 940)) - got[10 * n + 1] == set(), n
    assert set(range(20, 520)) <= got[91]
    assert not {0, 10, 20, 30, 90} & got.keys()


def test_fragments_in_earlier_texts_do_not_hide_a_passage(spark):
    """Passages of 50 to 60 words shared by two texts, the middles or halves of which earlier texts hold."""
    rng = random.Random(7)
    rows, want = [], {}

    def add(text):
        rows.append((len(rows), f"{unique(rng, 12)} {text} {unique(rng, 12)}"))
        return len(rows) - 1

    for case in range(40):
        size = (50, 55, 60, 80)[case % 4]
        words = unique(rng, size).split()
        if case % 4 < 2:
            add(" ".join(words[3 : size - 3]))
        else:
            add(" ".join(words[: size // 2]))
            add(" ".join(words[size // 2 :]))
        # The first holder of the passage also has a fragment of it before.
        first = add(" ".join([*words[5:40], *unique(rng, 5).split(), *words]) if case % 8 > 3 else " ".join(words))
        want[add(" ".join(words))] = (first, size)
    got = covered(substring.repeated_passages(frame(spark, rows)))
    lost = [i for i, (_, size) in want.items() if not set(range(12, 12 + size)) <= got.get(i, set())]
    assert not lost
    assert not {first for first, _ in want.values()} & got.keys()

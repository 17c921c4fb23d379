"""Best-fit packing of token sequences through the configuration linear program.

Documents are encoded, closed with id 0 and, where longer than a sequence, cut into full pieces and a rest. Only the
histogram of piece lengths, which has no more entries than a sequence has tokens, reaches the driver. There the
configuration LP (fewest sequences whose contents cover every length's count) is solved by multiplicative weights, whose
pricing step is a knapsack dynamic programme over the sequence length. The fractional solution is rounded to whole multiplicities
that the histogram can bear, the LP of what is left is solved again, and so on; the last few hundredths are filled greedily: the
longest piece left and the exact best fill beside it. Histograms that fit the sequence badly (many lengths between a third and a
half of it, say) leave the weights far from their end in bounded rounds; there a rounding that leaves more to the fill may need fewer sequences and counts.
The plan says, for ranges of ranks within each length, which sequence and offset a piece takes, so its size depends on
the sequence length and not on the data. A piece's rank is its place among its task's pieces of that length plus the
counts of the tasks before.

Defined results: a null or empty text has one token, the end id; rows that repeat an id are packed each; null ids
are packed like others; ties in rank fall as rows lie in the written table. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked_tokenizer import slices, tokenizer
from .common import stored

END_ID = 0
#: Pricing rounds of the multiplicative weights (more where few lengths leave few configurations to read from one), configurations
#: read from one pricing, and the step.
ROUNDS, MOST_ROUNDS, READ, STEP = 24, 240, 64, 0.2
#: Linear programmes that are solved one after the other. For each: the room that it lets a configuration leave, in multiples of the
#: mean room of its fractional solution, and the share of the best one's value that a configuration read from a pricing has or more.
#: They end when no more than a share ``REST`` of the volume is left.
PROGRAMMES = (*((room, 0.98) for room in np.geomspace(0.25, 4.0, 14).tolist()), *[(float("inf"), 0.0)] * 8)
REST, CLOSE = 0.03, 0.001


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): ``nth`` counts a task's pieces of the same length from 0."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            for s in slices(len(texts)):
                out: list[list] = [[], [], [], [], [], [], []]
                for i, packed in zip(ids[s], tokenizer(tokenizer_path).packed(texts[s]), strict=True):
                    data = packed + end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part_data = data[at : at + 4 * capacity]
                        n = len(part_data) // 4
                        for column, value in zip(out, (i, piece, at // 4, n, zlib.crc32(part_data), part, seen[n]), strict=True):
                            column.append(value)
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, piece int, start long, length int, ids_crc32 long, part int, nth long")


class Pricing:
    """The knapsack dynamic programme: the greatest value for each room, with no more pieces of a length than there are."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int):
        self.items = []
        for n, count, value in zip(lengths.tolist(), counts.tolist(), values.tolist(), strict=True):
            most, power = min(count, capacity // n), 1
            while most > 0:
                take = min(power, most)
                self.items.append((n, take, take * value))
                most, power = most - take, 2 * power
        self.best = np.zeros(capacity + 1)
        self.took = np.zeros((len(self.items), capacity + 1), bool)
        for row, (n, take, value) in zip(self.took, self.items, strict=True):
            size = n * take
            with_it = self.best[:-size] + value
            np.greater(with_it, self.best[size:], out=row[size:])
            np.maximum(with_it, self.best[size:], out=self.best[size:])

    def configuration(self, room: int) -> dict[int, int]:
        """Counts of each length with the greatest total value in ``room``."""
        out: dict[int, int] = {}
        upto = len(self.items)
        while upto and (taken := self.took[:upto, room].nonzero()[0]).size:
            upto = int(taken[-1])
            n, take, _ = self.items[upto]
            out[n] = out.get(n, 0) + take
            room -= n * take
        return out


def best_configuration(lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The pricing's answer: counts of each length, at most ``counts``, with the greatest total value in ``capacity``."""
    return Pricing(lengths, counts, values, capacity).configuration(capacity)


def fractional_configurations(histogram: dict[int, int], capacity: int, good: float) -> list[tuple[dict[int, int], float]]:
    """Configurations and their fractional counts, by multiplicative weights over the covering constraints.

    A length's weight falls with the share of its count that is covered. One pricing gives the best configuration and, for the lengths
    covered least, the best that holds the length, where that has the share ``good`` of the best one's value.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    weights = lengths * counts / float((lengths * counts).sum())
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    place = {n: i for i, n in enumerate(lengths.tolist())}
    for _ in range(min(MOST_ROUNDS, ROUNDS * max(1, READ // len(lengths)))):
        values = weights / counts
        pricing = Pricing(lengths, counts, values, capacity)
        held = [pricing.configuration(capacity)]
        for at in np.argsort(covered, kind="stable")[:READ].tolist():
            n = int(lengths[at])
            config = pricing.configuration(capacity - n)
            config[n] = config.get(n, 0) + 1
            if config[n] <= histogram[n] and values[at] + pricing.best[capacity - n] >= good * pricing.best[capacity]:
                held.append(config)
        for config in held:
            at = np.array([place[n] for n in config])
            share = np.array([config[n] for n in config]) / counts[at]
            amount = STEP / share.max()
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + amount
            covered[at] += amount * share
            weights[at] *= np.exp(-amount * share)
        weights /= weights.sum()
    scale = max(float(np.average(covered, weights=lengths * counts)), 1e-12)
    return [(dict(key), x / scale) for key, x in used.items()]


def _fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length left and the counts beside it that leave least room, longer lengths first."""
    longest = max(left)
    room = capacity - longest
    items = []
    for n in sorted((n for n in left if n <= room), reverse=True):
        count, power = min(left[n] - (n == longest), room // n), 1
        while count > 0:
            take = min(power, count)
            items.append((n, take))
            count, power = count - take, 2 * power
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for n, take in items:
        steps.append(reach)
        reach |= reach << n * take & mask
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out = {longest: 1}
    for (n, take), before in reversed(list(zip(items, steps, strict=False))):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + take
            at -= n * take
    return out


def solved(histogram: dict[int, int], capacity: int, programmes: int = len(PROGRAMMES)) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """Configurations and whole counts that together hold the histogram exactly: those of the linear programmes, and the greedy rest."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[dict[int, int], int]] = []
    rest: list[tuple[dict[int, int], int]] = []

    def take(to: list, config: dict[int, int], whole: int) -> None:
        to.append((config, whole))
        for n, k in config.items():
            left[n] -= whole * k
            if not left[n]:
                del left[n]

    if full := left.get(capacity, 0):
        take(out, {capacity: 1}, full)
    volume = sum(n * c for n, c in left.items())
    for part, good in PROGRAMMES[:programmes]:
        if sum(n * c for n, c in left.items()) <= max(2 * capacity, REST * volume):
            break
        fractional = sorted(fractional_configurations(left, capacity, good), key=lambda c: -c[1])
        rooms = [capacity - sum(n * k for n, k in config.items()) for config, _ in fractional]
        most = 1 + part * max(1e-9, float(np.average(rooms, weights=[x for _, x in fractional])))
        carried = 0.0
        for (config, x), room in zip(fractional, rooms, strict=True):
            # The fractions lost by rounding down are carried on to the next configuration.
            carried += x
            whole = min([int(carried)] + [left.get(n, 0) // k for n, k in config.items()])
            if whole and room <= most:
                carried -= int(carried)
                take(out, config, whole)
    while left:
        config = _fill(left, capacity)
        take(rest, config, min(left[n] // k for n, k in config.items()))
    return out, rest


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and whole counts that together hold the histogram exactly.

    Where the programmes' rounding ends further than ``CLOSE`` from the bound by volume, roundings that leave more to the fill are tried
    too, and the one of fewest sequences counts.
    """
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best: list[tuple[dict[int, int], int]] | None = None
    for programmes in (len(PROGRAMMES), 4, 1, 0):
        now = [x for part in solved(histogram, capacity, programmes) for x in part]
        if best is None or sum(w for _, w in now) < sum(w for _, w in best):
            best = now
        if sum(w for _, w in best) <= bound * (1 + CLOSE) + 1:
            break
    return best


def rank_plan(configs: list[tuple[dict[int, int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) and for each the first sequence, pieces to a sequence and first offset."""
    shift, rows, taken, sequence = 1 << 48, [], {}, 0
    for config, whole in configs:
        offset = 0
        for n in sorted(config, reverse=True):
            rows.append((n * shift + taken.get(n, 0), sequence, config[n], offset))
            taken[n] = taken.get(n, 0) + whole * config[n]
            offset += n * config[n]
        sequence += whole
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of each row of ``docs``."""
    rows = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, sequence, per, offset = rank_plan(configurations(histogram, capacity), capacity)

    def place(batches):
        for batch in batches:
            length, nth, first = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "nth", "base"))
            rank = length * (1 << 48) + nth + first
            at = np.searchsorted(keys, rank, side="right") - 1
            past = rank - keys[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + past // per[at]), pa.array(offset[at] + past % per[at] * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.join(base, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", "nth", "base").mapInArrow(place, "id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")

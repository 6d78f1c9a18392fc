"""Best-fit packing of token pieces into sequences, by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence; the program covers every length's pieces by as few
configurations, in fractions, as it can. Multiplicative weights price the lengths: a knapsack dynamic program finds, for each
length, the configuration of greatest price that holds it, and lengths that are behind in their cover become dearer than others.
A configuration is used as often as the scarcest of its lengths allows, so no length is covered more than once, and only
if its price is near the greatest one. Any prices bound the program from below (their worth over the greatest price of a
configuration), which proves how good a plan is. The fractional solution is rounded, in order, to whole numbers of
sequences, and what that leaves of each length is packed by best fit, longest first; so is all of it, and the least plan counts.
The plan depends on the histogram alone, at most `capacity` numbers; the pieces are dealt to it by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.llm.common import documents, stored
from lumenweir.operators.ranks import parts_for, ranked
from lumenweir.llm.tokens import token_pieces

CAPACITY = 2048
#: Knapsacks of a solution; the share of the material that it may leave uncovered.
ROUNDS, LEFT = 80, 0.01
#: Two ways to solve: step of the multiplicative weights, how far below the greatest price a configuration may lie, and the
#: share of a length that one knapsack may cover.
WAYS = ((1.0, 0.01, 1.0), (4.0, 0.004, 0.5))
#: Shares of the fractional solution, from its beginning, that are rounded.
SHARES = (1.0, 0.9, 0.75)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest price of a multiset of lengths for each size up to capacity, and the index of its last length (-1: none, -2: as one size less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -2
        if k := upto[c]:
            v = best[c - lengths[:k]] + prices[:k]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], last[c] = v[i], i
    return best, last


def taken(lengths: list[int], last: list[int], size: int) -> dict[int, int]:
    """index of length -> times, of the best multiset for a size."""
    out: dict[int, int] = {}
    while size > 0 and last[size] != -1:
        if (i := last[size]) == -2:
            size -= 1
        else:
            out[i] = out.get(i, 0) + 1
            size -= lengths[i]
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, way: tuple[float, float, float] = WAYS[0]) -> tuple[dict[tuple, float], float]:
    """configuration ((index, times), ...) -> how often, covering no length more than once and all but about LEFT of the
    material (less after ROUNDS knapsacks), and a lower bound on the sequences of any packing."""
    step, tolerance, share = way
    need = counts.astype(float)
    rest, material = need.copy(), float(need @ lengths)
    bound, use = 0.0, {}
    for _ in range(ROUNDS):
        behind = float(rest @ lengths) / material
        open_ = np.flatnonzero(rest)
        if behind <= LEFT or not len(open_):
            break
        own, allowed = lengths[open_], np.minimum(rest[open_], share * need[open_])
        prices = own / capacity * np.exp(step * (rest[open_] / need[open_] - behind))
        best, last = knapsack(own, prices, capacity)
        top, size, last = best[capacity], own.tolist(), last.tolist()
        bound = max(bound, float(prices @ need[open_]) / top)
        covered = 0.0
        for i in range(len(size) - 1, -1, -1):  # the longest first, which leaves the short ones to fill up
            if allowed[i] <= 0 or prices[i] + best[capacity - size[i]] < (1 - tolerance) * top:
                continue
            config = taken(size, last, capacity - size[i])
            config[i] = config.get(i, 0) + 1
            times = min(allowed[j] / m for j, m in config.items())
            if times <= 0:
                continue
            for j, m in config.items():
                allowed[j] = max(allowed[j] - times * m, 0)
                rest[open_[j]] = max(rest[open_[j]] - times * m, 0)
                covered += times * m * size[j]
            key = tuple(sorted((int(open_[j]), m) for j, m in config.items()))
            use[key] = use.get(key, 0.0) + times
        rest[rest < 1e-9 * need] = 0
        if covered < 0.01 * behind * material:  # what is left can't fill sequences at these prices
            tolerance *= 2
    return use, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, for all pieces of a length at once: equal sequences are one entry with a count."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for n in sorted(left, reverse=True):
        k = left[n]
        while k:
            free = min((f for f in bins if f >= n), default=None)
            if free is None:
                each = capacity // n
                full, rest = divmod(k, each)
                for times, m in ((full, each), (1 if rest else 0, rest)):
                    if times:
                        bins.setdefault(capacity - m * n, []).append(({n: m}, times))
                break
            config, times = bins[free].pop()
            each = free // n
            use = min(times, k // each)
            if use < times:
                if not use:  # fewer pieces than one sequence has room for
                    each, use = k, 1
                if times > use:
                    bins[free].append((config, times - use))
            k -= each * use
            if not bins[free]:
                del bins[free]
            bins.setdefault(free - each * n, []).append((config | {n: config.get(n, 0) + each}, use))
    return [x for many in bins.values() for x in many]


def rounded(use: dict[tuple, float], lengths: np.ndarray, counts: np.ndarray, share: float, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Whole numbers of sequences of the first part of a fractional solution, within what there is of each length, and the best
    fit of the rest; and how many are of the solution. What rounding takes from one configuration the next ones get."""
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plan: list[tuple[dict[int, int], int]] = []
    most, total = share * sum(use.values()), 0.0
    for key, times in use.items():
        if total + times > most * (1 + 1e-9):
            break
        config = {int(lengths[j]): m for j, m in key}
        whole = min(int(total + times) - int(total), *(left[n] // m for n, m in config.items()))
        total += times
        if whole > 0:
            plan.append((config, whole))
            for n, m in config.items():
                left[n] -= m * whole
    return plan + best_fit({n: c for n, c in left.items() if c}, capacity), sum(times for _, times in plan)


def solved(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """(plan, sequences of it that are configurations of the program, lower bound): the plan has (multiset of lengths, times), each
    within capacity, covers the histogram exactly, and is the least of the roundings and of best fit alone."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    if not len(lengths):
        return [], 0, 0.0
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    plans, bound = [], 0.0
    for way in WAYS:
        use, below = fractional(lengths, counts, capacity, way)
        bound = max(bound, below)
        plans += [rounded(use, lengths, counts, share, capacity) for share in SHARES]
    plans.append((best_fit(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity), 0))
    plan, own = min(plans, key=lambda x: (sum(times for _, times in x[0]), -x[1]))
    return plan, own, bound


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """The plan of solved()."""
    return solved(histogram, capacity)[0]


def intervals(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: where a run begins, its first sequence, pieces a sequence, and the first one's offset."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for config, times in plan:
        at = 0
        for n in sorted(config, reverse=True):
            m = config[n]
            rows.append((n, used.get(n, 0), first, m, at))
            used[n] = used.get(n, 0) + m * times
            at += n * m
        first += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "begin", "first", "each", "at"))}


def packed_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32): each sequence is gapless from 0, within capacity.

    The histogram (at most `capacity` rows) is all that reaches the driver, the plan's runs (at most capacity x the
    configurations of a histogram) are all that is broadcast; neither grows with the pieces. Lengths must lie between 1 and
    capacity. Null doc_ids are packed like others; repeated rows are packed one by one; an empty table gives an empty result.
    Ties of a length go by a hash of the row.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    shipped = spark.sparkContext.broadcast(intervals(configurations(histogram, capacity)))
    salt = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    bucket = F.pmod(salt, F.lit(parts_for(sum(histogram.values())))).cast("int")
    places = ranked(pieces, "length", bucket, [salt, "doc_id", "piece", "ids_crc32"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        wide = 1 << 44  # more pieces of one length than any corpus has
        keys = p["length"] * wide + p["begin"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, length * wide + rank, "right") - 1
            q, r = np.divmod(rank - p["begin"][i], p["each"][i])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p["first"][i] + q), pa.array(p["at"][i] + r * length)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    return places.select(*names[:5], "rank").mapInArrow(place, kind)


def packed_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces, packed; see token_pieces() and packed_pieces()."""
    return packed_pieces(token_pieces(docs, vocabulary_path, capacity), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}

"""Best-fit packing by bin completion.

What matters for packing is how many pieces there are of each length, at most
``max_len`` counts whatever the data.  Over those counts a branch-and-bound search
runs: it takes the largest piece left, enumerates the undominated fillings of the
room beside it, goes down the one that wastes least first, and cuts every branch
whose waste can no longer beat the best packing known (the incumbent, at first the
best-fit packing).  A filling is applied as often as the counts allow at once, so
the search is as small for a billion pieces as for a thousand.  The result is a
short list of patterns; each piece finds its sequence and offset from its number
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import numbered, text_of
from formloom.llm.tokenization import encoder
from formloom.session import stage

#: Search nodes before the incumbent is taken, and fillings of each node made greedily, ahead of all others.
NODES, GREEDY = 3000, 24

Pattern = tuple[tuple[int, ...], int]


# -- bin completion over length counts ------------------------------------------
def _fits(small: tuple[int, ...], into: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` can be packed into bins of the sizes ``into``."""
    if not small:
        return True
    tried = set()
    for i, room in enumerate(into):
        if room >= small[0] and room not in tried:
            tried.add(room)
            if _fits(small[1:], into[:i] + (room - small[0],) + into[i + 1 :]):
                return True
    return False


def greedy_fillings(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Some maximal fillings of ``room`` (lengths in falling order), least waste first,
    without those that another one dominates: what :func:`fillings` begins with."""
    if room == 0:
        return [()]
    if counts[room]:
        return [(room,)]
    at = np.where(counts[: room + 1] > 0, np.arange(room + 1), 0)
    floor = np.maximum.accumulate(at)  # the largest length at most x
    have = np.flatnonzero(counts[: room + 1])[::-1]
    if not len(have):
        return [()]

    def complete(items: list[int]) -> tuple[int, ...]:
        left = room - sum(items)
        used = list(items)
        x = left
        while x > 0:
            a = int(floor[x])
            if a == 0:
                break
            if used.count(a) < counts[a]:
                used.append(a)
                left -= a
                x = min(left, a)
            else:
                x = a - 1
        return tuple(sorted(used, reverse=True))

    found = {complete([int(a)]) for a in have}
    if not any(sum(f) == room and len(f) == 2 for f in found):
        wide = have[:: max(1, len(have) // 24)]
        for a in wide:
            for b in wide:
                if a >= b and a + b <= room and (a != b or counts[a] > 1):
                    found.add(complete([int(a), int(b)]))
    ordered = sorted(found, key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    kept: list[tuple[int, ...]] = []
    for f in ordered:
        if len(kept) == GREEDY:
            break
        if len(f) > 8 or not any(_fits(f, k) for k in kept if len(k) <= 8):
            kept.append(f)
    return kept


def fillings(counts: np.ndarray, room: int, spare: Callable[[], int]) -> Iterator[tuple[int, ...] | None]:
    """All maximal fillings of ``room`` that no earlier one dominates: the greedy ones,
    then the rest in order of waste as long as ``spare()`` allows it, made when asked for.
    None for one that is left out, so that the caller can count the work."""
    counts = counts.copy()
    kept = greedy_fillings(counts, room)
    yield from kept
    if room == 0 or counts[room]:
        return  # nothing, or one piece, dominates all
    have = [int(a) for a in np.flatnonzero(counts[: room + 1])[::-1]]
    many = {a: min(int(counts[a]), room // a) for a in have}
    sums = [1]  # bit s: the lengths from here on can come to s
    for a in reversed(have):
        reach, c, k = sums[-1], many[a], 1
        while c > 0:
            reach |= reach << min(k, c) * a
            c, k = c - k, 2 * k
        sums.append(reach & ((2 << room) - 1))
    sums.reverse()

    def exact(i: int, rest: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
            return
        while sums[i] >> rest & 1:
            a = have[i]
            i += 1
            for t in range(min(many[a], rest // a), 0, -1):
                if sums[i] >> rest - t * a & 1:
                    for more in exact(i, rest - t * a):
                        yield (a,) * t + more

    for waste in range(room + 1):
        if waste > spare():
            return
        for f in exact(0, room - waste):
            more_fits = any(a <= waste and f.count(a) < many[a] for a in have)
            if more_fits or f in kept or any(_fits(f, k) for k in kept if max(len(f), len(k)) <= 8):
                yield None
            else:
                kept.append(f)
                yield f


def _take(counts: np.ndarray, bin_: tuple[int, ...]) -> int:
    """How often the counts allow a bin."""
    lengths, times = np.unique(bin_, return_counts=True)
    return int((counts[lengths] // times).min())


def _apply(counts: np.ndarray, bin_: tuple[int, ...], times: int) -> None:
    for x in bin_:
        counts[x] -= times


def best_fit(counts: np.ndarray, max_len: int) -> list[Pattern]:
    """The first incumbent: the largest piece left, then ever the largest that fits."""
    counts, out = counts.copy(), []
    while counts.any():
        big = int(np.flatnonzero(counts)[-1])
        bin_, left = [big], max_len - big
        counts[big] -= 1
        while left > 0:
            fit = np.flatnonzero(counts[: left + 1])
            if not len(fit):
                break
            bin_.append(int(fit[-1]))
            counts[fit[-1]] -= 1
            left -= int(fit[-1])
        for x in bin_:
            counts[x] += 1
        times = _take(counts, tuple(bin_))
        _apply(counts, tuple(bin_), times)
        out.append((tuple(bin_), times))
    return out


def n_bins(patterns: list[Pattern]) -> int:
    return sum(times for _, times in patterns)


def complete_bins(counts: np.ndarray, max_len: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that pack ``counts[length]`` pieces of each length: the best packing the
    search finds within ``nodes`` nodes among greedy fillings and as many among all of them,
    from the better packing on.  It is proven least where it meets the lower bound,
    or where the second search ends before its nodes do: no filling is left out but for its waste
    or for one that dominates it, and each is also applied less often than it could be."""
    counts = counts.astype(np.int64).copy()
    best = best_fit(counts, max_len)
    for whole in (False, True):
        best = _search(counts.copy(), max_len, nodes, best, whole)
    return best


def _search(counts: np.ndarray, max_len: int, nodes: int, best: list[Pattern], whole: bool) -> list[Pattern]:
    """The best packing found, at first ``best``; uses up ``counts``."""
    total = int((counts * np.arange(len(counts))).sum())
    least = -(-total // max_len)
    path: list[Pattern] = []
    frames: list[list] = []
    wasted = seen = 0

    def descend() -> bool:
        """Opens the next node; false at a complete packing."""
        left = np.flatnonzero(counts)
        if not len(left):
            return False
        big = int(left[-1])
        counts[big] -= 1
        options = fillings(counts, max_len - big, spare) if whole else iter(greedy_fillings(counts, max_len - big))
        first = next(options)
        counts[big] += 1
        frames.append([big, tried(big, chain([first], options)), None])
        return True

    def spare() -> int:
        """The waste left to a packing of fewer sequences than the incumbent."""
        return (n_bins(best) - 1) * max_len - total - wasted

    def tried(big: int, options: Iterator) -> Iterator:
        """Fillings as often as they go, then all of them less often."""
        often = []
        for f in options:
            if f is not None:
                times = _take(counts, (big, *f))
                if whole and times > 1:
                    often.append((f, times))
                yield f, times
            else:
                yield None
        for f, most in often:
            for times in range(most - 1, 0, -1):
                yield f, times

    if n_bins(best) > least:
        descend()
    while frames and n_bins(best) > least and seen < nodes:
        frame = frames[-1]
        if frame[2]:  # undo the filling tried before
            bin_, times = frame[2]
            _apply(counts, bin_, -times)
            wasted -= times * (max_len - sum(bin_))
            path.pop()
            frame[2] = None
        option = next(frame[1], ())
        if option == ():
            frames.pop()
            continue
        seen += 1
        if option is None:
            continue
        bin_, times = (frame[0], *option[0]), option[1]
        if times * (max_len - sum(bin_)) > spare():
            continue  # can't need fewer sequences than the incumbent
        _apply(counts, bin_, times)
        wasted += times * (max_len - sum(bin_))
        path.append((bin_, times))
        frame[2] = (bin_, times)
        if not descend():
            best = list(path)
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, from, to, in_bin, sequence, offset).

    Pieces of a length are numbered from 0; those numbered ``from`` to before ``to`` fill
    ``in_bin`` neighbouring slots, from ``offset`` on, of sequence after sequence.
    """
    at, sequence, out = {}, 0, []
    for bin_, times in patterns:
        offset = 0
        for length in dict.fromkeys(bin_):
            k = bin_.count(length)
            start = at.get(length, 0)
            out.append((length, start, start + k * times, k, sequence, offset))
            at[length] = start + k * times
            offset += k * length
        sequence += times
    return out


# -- pieces --------------------------------------------------------------------
#: Keys travel as text: pandas would turn bigints beside a null into doubles.
PIECES = "key string, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, max_len: int, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["_text"], strict=True):
                ids = np.array([*encode(text), end], "<u4")
                first = len(ids) % max_len or max_len
                cuts = [0, *range(first, len(ids) + 1, max_len)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids_crc32"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, max_len: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text",
    nodes: int = NODES,
) -> DataFrame:
    """Every piece of every document in its sequence: key, piece, start, length,
    ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer for the whole text, then ``end``.
    Only documents of more than ``max_len`` ids are cut, into pieces of ``max_len``; the
    first piece takes what is left over.  Sequences hold at most ``max_len`` ids
    without gaps.  ids_crc32 is the unsigned CRC-32 of the piece's little-endian
    32-bit ids.

    A null text is empty (one piece, the end id); repeated rows are packed each for
    itself; null keys are kept; an empty table gives an empty result; further columns
    are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    texts = docs.select(F.col(key).cast("string").alias("key"), text_of(text).alias("_text"))
    cut = texts.mapInPandas(_pieces(tokenizer, max_len, end), PIECES)
    pieces = stage(cut.withColumn("key", F.col("key").cast(kind)), "pieces")
    sums = pieces.groupBy("length").count().collect()  # at most max_len rows
    counts = np.zeros(max_len + 1, np.int64)
    for row in sums:
        counts[row["length"]] = row["count"]
    slots = places(complete_bins(counts, max_len, nodes))
    before = np.concatenate([[0], np.cumsum(counts)])  # pieces of smaller lengths
    table = spark.createDataFrame(
        [(n, a + int(before[n]), b + int(before[n]), k, s, o) for n, a, b, k, s, o in slots],
        "_length bigint, _from bigint, _to bigint, _in_bin bigint, _sequence bigint, _offset bigint",
    )  # a few slots for each length, whatever the data
    ranked = numbered(pieces, ["length", "key", "piece", "ids_crc32"], "_number")
    inside = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to"))
    nth = F.col("_number") - F.col("_from")
    return ranked.join(F.broadcast(table), inside).select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_in_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_in_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )

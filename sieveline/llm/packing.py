"""Texts into containers of fixed capacity by bin completion.

Texts are spread over blocks of about ``block_rows`` by hash and every block is packed
for itself, so a task holds a bounded group however skewed the table is; the room lost
to blocks is at most one partly filled container each.

Within a block the container is built around the largest text left. The fillings around
it are enumerated, the fullest first by bands of room left, and dominated ones are left
out: a filling is dominated if some text outside it could take the place of part of it
that is smaller or has more texts, without going over the capacity. A branch is cut where the
room wasted so far exceeds what a better solution may waste, and the best-fit
decreasing solution is the first incumbent. The search ends when a solution meets the
lower bound ceil(sum / capacity), when all branches are done, which proves the best, or
after ``max_steps`` steps with the best solution so far; None sets no end. The end never
leaves a text out: every text is in a container, there may only be one container more
than needed. ``block_report`` tells the gap to the bound for each block.

Sizes are tokens of the byte-level ByT5 vocabulary: one per UTF-8 byte and one end
token. A text above the capacity is cut into full containers and a rest, which is
packed like a text. Nulls and edge cases: a null text has no tokens and is left out,
an empty one has size 1; equal sizes are taken in the order of their keys.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over sizes in falling order; gives lists of sizes."""
    rooms: list[tuple[int, int]] = []  # (room, container) in rising order
    out: list[list[int]] = []
    for s in sizes:
        i = bisect_right(rooms, (s, -1))
        if i < len(rooms):
            room, c = rooms.pop(i)
            out[c].append(s)
        else:
            room, c = capacity, len(out)
            out.append([s])
        if room > s:
            insort(rooms, (room - s, c))
    return out


class _Ended(Exception):
    """The steps of a search are used up."""


class _Steps:
    def __init__(self, most: int | None):
        self.left = most

    def step(self) -> None:
        if self.left is not None:
            self.left -= 1
            if self.left < 0:
                raise _Ended


def _between(sizes: list[int], low: int, high: int) -> int:
    """How many of the rising sizes are from ``low`` to ``high``."""
    return bisect_right(sizes, high) - bisect_left(sizes, low)


def dominated(filling: tuple[int, ...], slack: int, left: list[int]) -> bool:
    """Whether a text of the rising ``left`` that is not in the ``filling`` can stand for part of it: for no text, for
    one that is smaller, or for several that are not larger, with ``slack`` to spare."""
    inside = sorted(filling)
    parts = {0: 0}  # sum of a part: its number of texts, the most where sums are equal
    for s in filling:
        for total, n in list(parts.items()):
            parts[total + s] = max(parts.get(total + s, 0), n + 1)
    for total, n in parts.items():
        low = total if n > 1 else total + 1
        if _between(left, low, total + slack) > _between(inside, low, total + slack):
            return True
    return False


def fillings(left: list[int], room: int, most_slack: int, steps: _Steps | None = None, *, first: int = 0) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` with texts of the rising ``left`` that leave ``most_slack`` at most.

    They come by bands of slack, the first one up to ``first``, and within a band those of larger texts first.
    """
    steps = steps or _Steps(None)
    below = [0, *accumulate(left)]
    low, high = 0, min(first, most_slack)
    while low <= min(most_slack, room):
        if low <= room <= high and not dominated((), room, left):
            yield ()
        chosen: list[int] = []
        # depth first over texts in falling order; a frame is how many texts may come next and the room left
        frames = [[bisect_right(left, room - low), room]]
        while frames:
            i, rest = frames[-1]
            if i < 1 or below[i] < rest - high:  # not even all that may come fill it up
                frames.pop()
                if chosen:
                    chosen.pop()
                continue
            steps.step()
            size = left[i - 1]
            frames[-1][0] = bisect_left(left, size, 0, i)  # the next one in its place is smaller
            chosen.append(size)
            rest -= size
            if rest <= high and not dominated(tuple(chosen), rest, left):
                yield tuple(chosen)
            frames.append([bisect_right(left, rest - low, 0, i - 1), rest])
        low, high = high + 1, min(most_slack, 4 * high + 3)


def complete(sizes: list[int], capacity: int, *, max_steps: int | None = 100_000) -> list[list[int]]:
    """Containers as lists of sizes; every size is between 1 and ``capacity``. With ``max_steps=None`` there are no fewer containers possible."""
    down = sorted(sizes, reverse=True)
    best = _best_fit(down, capacity)
    total = sum(down)
    bound = -(-total // capacity)
    steps = _Steps(max_steps)
    while len(best) > bound:
        allowed = (len(best) - 1) * capacity - total  # what a better solution may waste
        try:
            found = _better(down[::-1], capacity, allowed, steps)
        except _Ended:
            break
        if found is None:
            break
        best = found
    return best


def _better(left: list[int], capacity: int, allowed: int, steps: _Steps) -> list[list[int]] | None:
    """A solution that wastes ``allowed`` at most, the last container's room included, or None where there is none."""

    def node(texts: list[int], waste: int) -> tuple:
        """Its largest text, the others, the waste so far and the fillings around that text."""
        big, rest = texts[-1], texts[:-1]
        steps.step()
        # the first fillings may leave an even share of what may still be wasted, so that small texts are kept for later
        share = (allowed - waste) // -(-sum(texts) // capacity)
        return big, rest, waste, fillings(rest, capacity - big, allowed - waste, steps, first=share)

    if not left:
        return []
    path = [node(left, 0)]
    chosen: list[list[int]] = []
    while path:
        big, rest, waste, options = path[-1]
        filling = next(options, None)
        if filling is None:
            path.pop()
            if chosen:
                chosen.pop()
            continue
        after = rest.copy()
        for s in filling:
            del after[bisect_left(after, s)]
        chosen.append([big, *filling])
        if not after:
            return chosen
        path.append(node(after, waste + capacity - big - sum(filling)))
    return None


def pack(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 4096, block_rows: int = 2048, max_steps: int | None = 100_000
) -> DataFrame:
    """(key, piece, n_pieces, first_token, n_tokens, container): where each text, or each piece of an oversized one, goes.

    ``container`` is unique over the table, its upper half is the block. ``key`` must be unique; rows repeated whole count
    once; rows without a key are left out.
    """
    sized = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), (F.octet_length(text) + 1).alias("size")).distinct()
    n_blocks = max(1, -(-df.count() // block_rows))
    kind = df.schema[key].dataType.simpleString()

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        no = int(pdf["b"].iloc[0])
        pdf = pdf.sort_values(["size", "k"], ascending=[False, True])
        rows: list[tuple] = []
        ready: dict[int, list[tuple]] = {}
        sizes: list[int] = []
        made = 0
        for k, size in zip(pdf["k"].tolist(), pdf["size"].tolist()):
            n = -(-size // capacity)
            for p in range(n):
                at = p * capacity
                s = min(capacity, size - at)
                row = (k, p, n, at, s)
                if s == capacity:
                    rows.append((*row, no * (1 << 32) + made))
                    made += 1
                else:
                    ready.setdefault(s, []).append(row)
                    sizes.append(s)
        for pile in ready.values():
            pile.reverse()
        for c in complete(sizes, capacity, max_steps=max_steps):
            rows += [(*ready[s].pop(), no * (1 << 32) + made) for s in c]
            made += 1
        return pd.DataFrame(rows, columns=["k", "piece", "n_pieces", "first_token", "n_tokens", "container"])

    packed = (
        sized.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(n_blocks)).cast("long"))
        .groupBy("b")
        .applyInPandas(block, f"k {kind}, piece int, n_pieces int, first_token long, n_tokens int, container long")
    )
    return packed.withColumnRenamed("k", key)


def block_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """(block, containers, tokens, lower_bound, gap): for each block how many containers it has beyond the least that could do."""
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    by = used.groupBy(F.shiftright("container", 32).alias("block")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return by.withColumn("lower_bound", F.ceil(F.col("tokens") / capacity)).withColumn("gap", F.col("containers") - F.col("lower_bound"))


def packing_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them and the share of room left."""
    t = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return t.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).alias("lower_bound"),
        F.coalesce(1 - F.sum("used") / (F.count("*") * capacity), F.lit(0.0)).alias("room_left"),
    )

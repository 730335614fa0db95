"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, numbered, table

#: Permitted sequence lengths, in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs: its length, so much beside it, and the square of its length over ATTENTION, as attention does. Short sequences
#: pay for themselves more often, long ones pay for their square; at these values 1,024 full words are cheapest by the word.
OVERHEAD, ATTENTION = 16, 65_536
#: Words and pieces that are packed together; blocks are packed on their own, so there are as many as the input needs.
BLOCK_WORDS, BLOCK_PIECES = 4_000_000, 100_000


def least_holding(n: int, capacities: tuple[int, ...]) -> int:
    return next(c for c in capacities if c >= n)


def cost_of(c: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return c + overhead + c * c / attention


class Waiting:
    """How many pieces of each length are still to come."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.there = sum(1 << n for n in self.count)  # bit n is set if a piece of n words waits

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.there &= ~(1 << n)

    def filling(self, room: int) -> list[tuple[int, int]]:
        """(length, how many) of the pieces still to come that ``room`` would take, largest first."""
        out, there = [], self.there
        while room > 0 and (fits := there & (2 << room) - 1):
            n = fits.bit_length() - 1
            out.append((n, min(self.count[n], room // n)))
            room -= n * out[-1][1]
            there &= (1 << n) - 1
        return out

    def filled(self, room: int) -> int:
        """Words of the ``filling``."""
        return sum(n * m for n, m in self.filling(room))


def fit(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD, attention: int = ATTENTION, widest: int | None = None) -> tuple[list[int], list[int], float]:
    """Bin and place of each length (in falling order), and what all bins cost once each is cut down to its contents.

    A piece goes to the open bin with the least room that holds it. If none does, a bin is opened: of size ``widest`` where the piece
    fits, or, without ``widest``, of the size that costs least for each word that it would hold, which the pieces still to come tell.
    """
    room_of: list[int] = []
    size_of: list[int] = []
    stacks: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set if a bin has room r
    waiting = Waiting([] if widest else lengths)
    price = {c: cost_of(c, overhead, attention) for c in capacities}
    bins, places = [], []

    def by_word(c: int, n: int) -> tuple[float, int]:
        held = n + waiting.filled(c - n)
        return price[least_holding(held, capacities)] / held, c

    for n in lengths:
        if not widest:
            waiting.take(n)
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_rooms &= ~(1 << room)
        else:
            able = [c for c in capacities if c >= n]
            size = next((c for c in able if c == widest), able[0]) if widest else min(able, key=lambda c: by_word(c, n))
            b, room = len(size_of), size
            size_of.append(size)
            room_of.append(size)
        bins.append(b)
        places.append(size_of[b] - room)
        room_of[b] = left = room - n
        if left:
            stacks.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return bins, places, sum(price[least_holding(s - r, capacities)] for s, r in zip(size_of, room_of, strict=True))


def complete(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], float]:
    """As ``fit``, but a bin is filled when it is opened, with the pieces that its price counted on, so that no two bins count on the
    same. Where small pieces are few, later bins see that they have gone, and other sizes win."""
    waiting, queue = Waiting(lengths), {}
    for i in reversed(range(len(lengths))):
        queue.setdefault(lengths[i], []).append(i)
    price = {c: cost_of(c, overhead, attention) for c in capacities}
    bins, places, b, cost = [0] * len(lengths), [0] * len(lengths), 0, 0.0
    while waiting.there:
        n = waiting.there.bit_length() - 1
        waiting.take(n)
        plans = [[(n, 1), *waiting.filling(c - n)] for c in capacities if c >= n]
        held = lambda plan: sum(x * m for x, m in plan)
        plan = min(plans, key=lambda p: (price[least_holding(held(p), capacities)] / held(p), held(p)))
        at = 0
        for j, (x, m) in enumerate(plan):
            for _ in range(m):
                i = queue[x].pop()
                bins[i], places[i], at = b, at, at + x
                if j:
                    waiting.take(x)
        b, cost = b + 1, cost + price[least_holding(at, capacities)]
    return bins, places, cost


def pack_block(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin, place and bin's final size of each length (in falling order), by the cheapest of: sizes that compete at each opening, in bins
    that are filled at once or stay open, or one size as a rule."""
    ways = [complete(lengths, capacities, overhead, attention), *(fit(lengths, capacities, overhead, attention, w) for w in (None, *capacities))]
    bins, places, _ = min(ways, key=lambda x: x[2])
    used: dict[int, int] = {}
    for b, n in zip(bins, lengths, strict=True):
        used[b] = used.get(b, 0) + n
    return bins, places, [least_holding(used[b], capacities) for b in bins]


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """Packs every word of ``docs`` (doc_id, text): one row per piece: doc_id, copy, piece, start, n_words, bin_id, bin_size, place.

    A text of more words than the largest size is cut into pieces of that size and a rest; start counts words. ``copy`` numbers the rows
    of the input by doc_id (null first), words and text, so a row that is repeated is packed as often, and how the input is stored
    doesn't matter. Rows without words are returned as one piece of 0 words without bin. Other columns play no part.
    Blocks of bounded size, by a hash of the row, are packed best-fit decreasing, with the sizes opened jointly: at each opening they
    compete by the cost of each word that the pieces still to come let them hold. In the end each bin is cut down to the least permitted
    size that holds it. Only doc_id and lengths are shuffled; the spans say what text goes where.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows, _ = numbered(docs.select("doc_id", words.alias("words"), F.xxhash64("text").alias("tie")), ["doc_id", "words", "tie"], "pack-rows")
    rows = rows.select("doc_id", F.col("row_no").alias("copy"), "words")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("words") / top) - 1))))
    pieces = pieces.withColumn("start", F.col("piece") * top).withColumn("n_words", F.least(F.lit(top), F.col("words") - F.col("start")).cast("long")).drop("words")
    total = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-total[0] // BLOCK_WORDS), -(-total[1] // BLOCK_PIECES))
    full = pieces.where("n_words > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(blocks)))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "copy", "piece"], ascending=[False, True, True], kind="stable")
        bins, places, sizes = pack_block(rows["n_words"].tolist(), capacities, overhead, attention)
        return rows.assign(bin_id=pd.Series(bins, rows.index, dtype="int64") + (int(key[0]) << 32), bin_size=sizes, place=places)[["doc_id", "copy", "piece", "start", "n_words", "bin_id", "bin_size", "place"]]

    kind = "doc_id long, copy long, piece long, start long, n_words long, bin_id long, bin_size long, place long"
    done = full.groupBy("block").applyInPandas(packed, kind)
    none = pieces.where("n_words = 0").select("doc_id", "copy", "piece", "start", "n_words", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_size", "place")])
    return done.unionByName(none)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))

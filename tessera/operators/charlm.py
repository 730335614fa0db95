"""A character language model: data set, random batches, a two-layer net whose gradients are added up over partitions, and sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import char_token, token_char
from tessera.sources.storage import checkpointed

VOCAB = 27
#: Numbers that the parameters of a net may have, since every task gets them all (64 MB).
MOST_PARAMETERS = 1 << 23
#: Partial gradients are added up in so many tasks, then in one.
FAN = 64
#: Steps whose batches are drawn at once.
TOGETHER = 1000
#: Hexadecimal digits of a row's hash by which a batch narrows down where its draws lie, at once; rows that are put in order at most.
DIGITS, ORDERED = 3, 100_000


# -- data set -------------------------------------------------------------------------------------------------------------------------


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(line, n): the words of all texts in small letters a to z, without anything else, and how often each occurs."""
    words = docs.select(F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word"))
    return words.select(F.regexp_replace(F.lower("word"), "[^a-z]", "").alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def prefix_rows(lines: DataFrame, text: str = "line", seq_len: int = 16) -> DataFrame:
    """``lines`` with n and tokens, one row for each prefix of each line: seq_len + 1 tokens, filled up with 0 from the left.

    The line end counts as the last token, 0. A line longer than seq_len is cut into pieces of that many characters, as a buffer of
    that size would read it; only its last piece has the line end.
    """
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text)) / seq_len).cast("int"))))
    cut = lines.withColumn("piece", piece).withColumn("_s", F.substring(F.concat(text, F.lit("\n")), F.col("piece") * seq_len + 1, F.lit(seq_len)))
    tokens = F.transform(F.filter(F.split("_s", ""), lambda c: c != ""), lambda c: char_token(c))
    rows = cut.where("_s <> ''").withColumn("_t", tokens).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("_t"))))
    width = seq_len + 1
    padded = F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(0), width - F.col("n"))), F.slice("_t", F.lit(1), F.col("n")))
    return rows.withColumn("tokens", padded).drop("_s", "_t")


def weighted_rows(lines: DataFrame, seq_len: int = 16) -> DataFrame:
    """(tokens, weight): the different prefixes of ``lines`` (line, n) and how often each occurs. A gradient over them, by weight, is the one
    over all prefixes, at the cost of the different ones."""
    rows = prefix_rows(lines.select("line", F.col("n").alias("weight")), seq_len=seq_len)
    return rows.groupBy("tokens").agg(F.sum("weight").cast("double").alias("weight"))


def inputs(tokens: str = "tokens"):
    """All tokens but the last."""
    return F.slice(tokens, F.lit(1), F.size(tokens) - 1)


def target(tokens: str = "tokens"):
    return F.element_at(tokens, -1)


def shown(tokens: str = "tokens"):
    return F.array_join(F.transform(tokens, lambda t: token_char(t)), "")


def split_rows(rows: DataFrame, number: str, n: int, part: float = 0.9) -> DataFrame:
    """``rows`` with is_train: the first int(n * part) by their number from 0."""
    return rows.withColumn("is_train", F.col(number) < int(n * part))


# -- random batches -------------------------------------------------------------------------------------------------------------------


def place(seed: int, draw: int, n: int) -> int:
    """Which of n rows, in the order of their hashes, draw number ``draw`` takes."""
    return int(hashlib.md5(f"{seed}:{draw}".encode()).hexdigest()[:15], 16) % n


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def touched(hashed: DataFrame, draws: list[tuple[int, int, str]], digits: int) -> DataFrame:
    """Rows whose hash starts like that of a draw."""
    if not digits:
        return hashed
    firsts = hashed.sparkSession.createDataFrame([(x,) for x in sorted({d[2] for d in draws})], "_start string")  # a row for each draw at most
    return hashed.join(F.broadcast(firsts), F.substring("_hash", 1, digits) == F.col("_start"), "left_semi")


def random_batch(rows: DataFrame, key: str, size: int, seed: int = 0, first: int = 0) -> DataFrame:
    """``size`` rows drawn with replacement, each with its draw's number ``b``, from ``first`` on: a row is as likely as any other in each draw.

    Draws are places in the order of the rows' hashes, which ``key`` names, so a batch doesn't depend on files or partitions. How the
    draws fall among the hashes is told from counts by their first digits, and from counts by more digits in what the draws touch until few
    rows are left, which are put in order; no row of the rest is numbered, sorted or shuffled. ``rows`` has no columns b or _hash.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("_hash", row_hash(key, seed))
    n = rows.count()
    draws = [(d, place(seed, d, n), "") for d in range(first, first + size)] if n else []  # number, place among those with the same first digits, digits
    digits, most = 0, n
    while draws and most > ORDERED and digits + DIGITS <= 32:
        start = F.substring("_hash", 1, digits + DIGITS)
        inside = touched(hashed, draws, digits)
        counts = {r[0]: r[1] for r in inside.groupBy(start).agg(F.count(F.lit(1))).collect()}  # 4,096 for each place touched
        starts, at = {}, {}
        for x in sorted(counts):
            above = x[:digits]
            starts.setdefault(above, []).append((at.get(above, 0), x))
            at[above] = at.get(above, 0) + counts[x]
        found = []
        for d, where, above in draws:
            begin, x = starts[above][np.searchsorted([s for s, _ in starts[above]], where, side="right") - 1]
            found.append((d, where - begin, x))
        draws, digits = found, digits + DIGITS
        most = max(counts[d[2]] for d in draws)
    wanted = spark.createDataFrame(draws, "b long, _place long, _first string")  # a row for each draw
    inside = touched(hashed, draws, digits).withColumn("_first", F.substring("_hash", 1, digits))
    placed = inside.withColumn("_place", F.row_number().over(Window.partitionBy("_first").orderBy("_hash", key)) - 1)
    return placed.join(F.broadcast(wanted), ["_first", "_place"]).drop("_first", "_place", "_hash")


# -- the net --------------------------------------------------------------------------------------------------------------------------


@dataclass
class Net:
    """Token vectors (token, dim), two layers (input, output) with their biases."""

    wte: np.ndarray
    fc1: np.ndarray
    b1: np.ndarray
    fc2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def random(seq_len: int = 16, dim: int = 16, hidden: int = 64, vocab: int = VOCAB, seed: int = 1) -> Net:
        """Uniform with a range by fan-in; biases 0."""
        r = np.random.default_rng(seed)
        some = lambda rows, cols, fan: r.uniform(-1, 1, (rows, cols)) / np.sqrt(fan)
        return Net(some(vocab, dim, dim), some(seq_len * dim, hidden, seq_len * dim), np.zeros(hidden), some(hidden, vocab, hidden), np.zeros(vocab))

    @property
    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    @property
    def seq_len(self) -> int:
        return len(self.fc1) // self.wte.shape[1]

    def checked(self) -> Net:
        if (n := sum(p.size for p in self.parts)) > MOST_PARAMETERS:
            raise MemoryError(f"{n} parameters are more than {MOST_PARAMETERS}")
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def like(self, flat: np.ndarray) -> Net:
        """Numbers in the order of ``flat`` as a net of this one's shapes."""
        ends = np.cumsum([p.size for p in self.parts])
        return Net(*[x.reshape(p.shape) for x, p in zip(np.split(flat, ends[:-1]), self.parts, strict=True)])

    def cells(self, spark: SparkSession) -> DataFrame:
        """(name, i, j, v); of biases i is 0."""
        rows = [(f.name, i, j, float(v)) for f in fields(self) for (i, j), v in np.ndenumerate(np.atleast_2d(getattr(self, f.name)))]
        return spark.createDataFrame(rows, "name string, i int, j int, v double")

    # what follows runs in tasks, on (rows, seq_len) tokens

    def layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the first layer, its outputs before they are cut at 0, and logits."""
        flat = self.wte[x].reshape(len(x), -1)
        pre = flat @ self.fc1 + self.b1
        return flat, pre, np.maximum(pre, 0) @ self.fc2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = self.layers(x)[2]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def slopes(self, tokens: np.ndarray, weight: np.ndarray) -> tuple[float, Net]:
        """The weighted sum of the losses, and its gradient."""
        x, y, rows = tokens[:, :-1], tokens[:, -1], np.arange(len(tokens))
        flat, pre, logits = self.layers(x)
        top = logits.max(1, keepdims=True)
        e = np.exp(logits - top)
        mass = e.sum(1, keepdims=True)
        loss = float(weight @ (np.log(mass[:, 0]) + top[:, 0] - logits[rows, y]))
        d = e / mass
        d[rows, y] -= 1
        d *= weight[:, None]
        hidden = np.maximum(pre, 0)
        dpre = (d @ self.fc2.T) * (pre > 0)
        dwte = np.zeros_like(self.wte)
        np.add.at(dwte, x.ravel(), (dpre @ self.fc1.T).reshape(-1, self.wte.shape[1]))
        return loss, Net(dwte, flat.T @ dpre, dpre.sum(0), hidden.T @ d, d.sum(0))


SUMS = "slot long, loss double, weight double, slopes binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sums of all."""
    loss = weight = 0.0
    slopes: np.ndarray | None = None
    for b in batches:
        for x, w, s in zip(*[b.column(c).to_pylist() for c in ("loss", "weight", "slopes")], strict=True):
            g = np.frombuffer(s)
            loss, weight, slopes = loss + x, weight + w, g.copy() if slopes is None else slopes + g
    if slopes is not None:
        yield pa.RecordBatch.from_pylist([{"slot": 0, "loss": loss, "weight": weight, "slopes": slopes.tobytes()}])


def gradient(batch: DataFrame, net: Net) -> tuple[float, Net]:
    """Mean loss over the rows of ``batch`` (tokens, weight), and its gradient.

    Each task adds up the gradient of its rows as one dense vector; the vectors are added up in FAN tasks, then in one, and one is what
    the driver gets. Every task has the parameters, of which there are MOST_PARAMETERS at most. Of no rows the loss is NaN and the gradient 0.
    """
    net.checked()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = weight = 0.0
        slopes = np.zeros(sum(p.size for p in net.parts))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                w = b.column(1).to_numpy(zero_copy_only=False)
                x, g = net.slopes(np.array(b.column(0).to_pylist(), np.int64), w)
                loss, weight, slopes = loss + x, weight + float(w.sum()), slopes + g.flat()
        if weight:
            yield pa.RecordBatch.from_pylist([{"slot": TaskContext.get().partitionId() % FAN, "loss": loss, "weight": weight, "slopes": slopes.tobytes()}])

    parts = batch.select("tokens", F.col("weight").cast("double")).mapInArrow(partial, SUMS)
    some = parts.repartition("slot").mapInArrow(_added, SUMS)  # up to FAN tasks; fewer where vectors are few
    row = some.repartition(1).mapInArrow(_added, SUMS).first()
    if row is None:
        return float("nan"), net.like(np.zeros_like(net.flat()))
    return row["loss"] / row["weight"], net.like(np.frombuffer(row["slopes"]) / row["weight"])


def loss(rows: DataFrame, net: Net) -> float:
    """Mean loss over ``rows`` (tokens, weight)."""
    return gradient(rows, net)[0]


def step(net: Net, slopes: Net, lr: float) -> Net:
    return net.like(net.flat() - lr * slopes.flat())


def train(rows: DataFrame, key: str, net: Net, steps: int, batch_size: int = 32, lr: float = 0.1, seed: int = 0) -> tuple[Net, list[float]]:
    """Stochastic gradient descent on random batches of ``rows`` (``key``, tokens); the driver holds the parameters between steps.

    What batches hold doesn't depend on the parameters, so those of TOGETHER steps are drawn at once: a pass over the rows serves them all,
    and a step reads what it drew.
    """
    rows, losses = checkpointed(rows.select(key, "tokens")), []
    for begin in range(0, steps, TOGETHER):
        some = min(TOGETHER, steps - begin)
        drawn = checkpointed(random_batch(rows, key, some * batch_size, seed, begin * batch_size).select("b", "tokens", F.lit(1.0).alias("weight")))
        for s in range(begin, begin + some):
            found, slopes = gradient(drawn.where((F.col("b") >= s * batch_size) & (F.col("b") < (s + 1) * batch_size)), net)
            losses.append(found)
            net = step(net, slopes, lr)
    return net, losses


# -- sampling -------------------------------------------------------------------------------------------------------------------------


def mixed(seed: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Uniform numbers in [0, 1) for ids and a step, by mixing their bits."""

    def draw(ids: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % (1 << 64))
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
            return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)

    return draw


def sample(contexts: DataFrame, net: Net, most: int = 64, draw: Callable[[np.ndarray, int], np.ndarray] = mixed(0)) -> DataFrame:
    """(id, tokens): what the net says after each of ``contexts`` (id long, tokens), up to its end, which is token 0, or ``most`` tokens.

    All contexts of a batch take a step at once; those that have ended leave, so a step costs what is still open. The first class whose
    running sum reaches the draw is taken, the last one if rounding leaves none. Contexts shorter than the net's are filled up with 0 from
    the left, of longer ones the end counts. A sequence depends on its id, its context and ``draw`` only.
    """
    net.checked()
    width = net.seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = np.array([([0] * width + (t or []))[-width:] for t in b.column(1).to_pylist()], np.int64).reshape(-1, width)
            said: list[list[int]] = [[] for _ in ids]
            open_ = np.arange(len(ids))
            for s in range(most):
                if not len(open_):
                    break
                sums = np.cumsum(net.probabilities(x[open_]), axis=1)
                reached = sums >= draw(ids[open_], s)[:, None]
                token = np.where(reached.any(1), reached.argmax(1), sums.shape[1] - 1)
                for at, t in zip(open_.tolist(), token.tolist(), strict=True):
                    said[at].append(t)
                x[open_] = np.concatenate([x[open_, 1:], token[:, None]], axis=1)
                open_ = open_[token != 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.list_(pa.int32()))], ["id", "tokens"])

    return contexts.select(F.col("id").cast("long"), "tokens").where("id IS NOT NULL").mapInArrow(run, "id long, tokens array<int>")


def sample_index(probabilities: DataFrame, draws: DataFrame) -> DataFrame:
    """(i, token): the first class whose running sum of p (i, j, v) reaches the draw (i, u); the last class if rounding leaves none."""
    cum = F.sum("v").over(Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    met = probabilities.withColumn("_c", cum).join(draws, "i")
    return met.groupBy("i").agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("u"), F.col("j"))), F.max("j")).alias("token"))


def shifted(context: str, token: str):
    """A context with the new token at its end and its first one gone."""
    return F.concat(F.slice(context, F.lit(2), F.size(context) - 1), F.array(F.col(token).cast("int")))

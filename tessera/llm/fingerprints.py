"""Document fingerprints: a randomised edit embedding, bit-sampled."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import beside, components, discard, materialise, table
from tessera.llm.grouping import Filter, Names, blocks_met, candidate_groups, connected, digests, leads, settled_names

#: Steps for which random bits are drawn at once; a step goes on by one character with probability a half.
STEPS = 2048
#: Walks from which on they take a step together; fewer go one by one.
TOGETHER = 64
#: Samples of a fingerprint, and consecutive outputs in each.
SAMPLES, RUN = 64, 16
#: Samples of a band: texts that agree in all of a band meet.
BAND = 3
#: Texts are near where they share at least NEAR of the longer one's runs of GRAM characters. Of those that meet, the ones whose
#: fingerprints have at least LIKELY in common are compared.
NEAR, LIKELY, GRAM = 0.75, 0.25, 16
#: Characters, and texts, embedded at once.
CHUNK, CHUNK_TEXTS = 3 << 20, 2000
SEED = 20


class Embedding:
    """A shared random walk over the characters of each text.

    The walk starts at the text's first character. At step j it puts out its character c and goes on by one if the random bit of (j, c)
    says so, else it stays; it takes as many steps as bring it past the last character, but for a chance of some 1e-8. All texts share
    these bits, so two that are an edit apart fall into step again soon after it and stay so, and their edit distance shows as a Hamming
    distance of their outputs. Characters that share a bit by their hash are still put out as themselves. The walks of many texts take
    each step together.

    A fingerprint samples SAMPLES runs of RUN outputs. Which runs does not depend on the text, only on how many there are: every run has
    a random bin and rank, and of each bin the run of lowest rank is sampled, so texts of different length mostly sample the same places.
    """

    def __init__(self, seed: int = SEED):
        self.seed, self.known = seed, 0
        self.class_of = classes(np.arange(0x110001, dtype=np.uint32))
        self._plan(1 << 16)

    def goes(self, part: int) -> np.ndarray:
        """The random bits (STEPS, 256) of the steps from ``part`` * STEPS on."""
        raw = np.random.Generator(np.random.Philox(key=[self.seed, part])).bytes(STEPS * 32)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(STEPS, 256)
        bits[:, 0] = 0  # the end of a text
        return bits

    def _plan(self, runs: int) -> None:
        """The sampled run of every bin, for any number of runs up to ``runs``."""
        r = np.arange(runs, dtype=np.uint64)
        bins, rank = _mix(r + np.uint64(self.seed)) % np.uint64(SAMPLES), _mix(r ^ np.uint64(self.seed << 32))
        events = []
        for b in range(SAMPLES):
            mine = np.flatnonzero(bins == b)
            low = np.minimum.accumulate(rank[mine])
            events += [(int(x), b) for x in mine[np.r_[True, low[1:] < low[:-1]]]] if len(mine) else []
        events.sort()
        self.at = np.array([x for x, _ in events], np.int64)
        self.chosen = np.full((len(events) + 1, SAMPLES), -1, np.int64)
        for i, (x, b) in enumerate(events):
            self.chosen[i + 1] = self.chosen[i]
            self.chosen[i + 1, b] = x
        self.known = runs

    def walks(self, flat: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        """Outputs of the walks from ``starts`` in ``flat``, where each text ends with a 0, and place(walk, step), which is where one lies.

        The outputs of a step lie side by side, longest walk first, and a walk that has ended takes no room.
        """
        order = np.argsort(-steps, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = steps[order][::-1]
        before = np.r_[0, np.cumsum(ends)]

        def base(j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Outputs before step j, and walks that take it."""
            gone = np.searchsorted(ends, j, "right")
            return before[gone] + j * (len(ends) - gone), len(ends) - gone

        class_of = self.class_of[flat]
        out = np.zeros(before[-1], np.uint32)
        at = starts[order].astype(np.int64)
        sym, go = np.empty(len(at), np.uint8), np.empty(len(at), np.uint8)
        for part in range(-(-int(steps.max(initial=0)) // STEPS)):
            bits = self.goes(part)
            first, live = base(np.arange(part * STEPS, (part + 1) * STEPS))
            if live[0] >= TOGETHER:
                for goes, a, n in zip(bits, first.tolist(), live.tolist(), strict=True):
                    here, cls, step = at[:n], sym[:n], go[:n]
                    np.take(flat, here, out=out[a : a + n], mode="clip")
                    np.take(class_of, here, out=cls, mode="clip")
                    np.take(goes, cls, out=step, mode="clip")
                    here += step
                continue
            plain = bits.tobytes()
            for i in range(live[0]):
                m = int(np.searchsorted(-live, -i, "left"))  # steps that more than i walks take
                x, k, got = class_of[at[i] : at[i] + m + 1].tobytes(), 0, bytearray(m)
                for j in range(m):
                    got[j] = go_on = plain[j << 8 | x[k]]
                    k += go_on
                moved = np.frombuffer(got, np.uint8).cumsum(dtype=np.int64)
                out[first[:m] + i] = flat[at[i] + np.r_[0, moved[:-1]]]
                at[i] += k
        return out, lambda walk, step: base(step)[0] + rank[walk]

    def prints(self, out: np.ndarray, place: Callable[[np.ndarray, np.ndarray], np.ndarray], n_out: np.ndarray) -> np.ndarray:
        """(texts, SAMPLES) uint16, 0 for a bin without a run inside the text. What a last run lacks counts as 0."""
        runs = -(-n_out // RUN)
        if runs.max(initial=0) > self.known:
            self._plan(1 << int(runs.max()).bit_length())
        run = self.chosen[np.searchsorted(self.at, runs, "left")]
        step = np.maximum(run, 0)[:, :, None] * RUN + np.arange(RUN)
        there = step < n_out[:, None, None]
        text = np.broadcast_to(np.arange(len(n_out))[:, None, None], step.shape)
        got = np.zeros(step.shape, np.uint32)
        got[there] = out[place(text[there], step[there])]
        h = np.zeros(run.shape, np.uint64)
        words = got.view(np.uint64)
        for i in range(words.shape[-1]):
            h = _mix(h ^ words[..., i])
        return np.where((run < 0) | (got[..., 0] == 0), 0, h % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def symbols(text: str) -> np.ndarray:
    """A number above 0 for each code point, another for each."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32) + np.uint32(1)


def classes(flat: np.ndarray) -> np.ndarray:
    """By which random bit each character goes on: 1 to 255, and 0 for the end of a text."""
    return np.where(flat == 0, 0, _mix(flat.astype(np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def steps_of(sizes: np.ndarray) -> np.ndarray:
    """Steps that take a walk past its last character: twice as many on average, and eight deviations of half a character more."""
    return np.where(sizes > 0, 2 * sizes + (8 * np.sqrt(sizes)).astype(np.int64) + 16, 0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of the sampled places, counting those that either text has, at which both agree; 1 if neither has any."""
    either = ((a > 0) | (b > 0)).sum(-1)
    return np.where(either == 0, 1.0, ((a == b) & (a > 0)).sum(-1) / np.maximum(either, 1))


def _hex(prints: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in prints]


def embed(texts: list[str], model: Embedding) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``texts``, and the steps of each's walk."""
    coded = [symbols(t) for t in texts]
    sizes = np.array([len(x) for x in coded], np.int64)
    end = np.zeros(1, np.uint32)
    flat = np.concatenate([p for x in coded for p in (x, end)]) if coded else end
    steps = steps_of(sizes)
    out, place = model.walks(flat, np.r_[0, np.cumsum(sizes + 1)][:-1], steps)
    return model.prints(out, place, steps), steps


def fingerprint_pairs(texts: list[str], model: Embedding) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text but the last, with the one after it: the edited text; prints of all texts and of the edited ones."""
    edited = []
    for t, after in zip(texts, texts[1:], strict=False):
        q = len(t) // 3
        edited.append(t[: len(t) - q] + after[:q])
    prints = embed(texts + edited, model)[0]  # more walks take each step together
    return edited, prints[: len(texts)], prints[len(texts) :]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of doc_id, sorted downwards, so that each row is followed by its next.

    The text is shuffled once. The first row of each range goes along with the range above as a guest, and that of the topmost range
    with the lowest. The bounds and the firsts are a number for each range. Null doc_ids are lowest and all in the lowest range; equal
    ones are in order of text.
    """
    ids = docs.select("doc_id")
    bounds = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = np.array(sorted(set(bounds)), np.int64)

    def range_of(ids: pa.Array) -> np.ndarray:
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"))

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(range_of(ids).astype(np.int32))

    tops = sorted((r["p"], r["m"]) for r in ids.groupBy(part("doc_id").alias("p")).agg(F.max("doc_id").alias("m")).collect())  # a row for each range
    if not tops:
        return docs.select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("guest"))
    follows = list(zip([*tops[-1:], *tops[:-1]], tops, strict=True))  # the first of the one range is a guest of the other
    host_of_null = next((host[0] for top, host in follows if top[1] is None), -1)
    known = sorted((top[1], host[0]) for top, host in follows if top[1] is not None)
    firsts, hosts = (np.array([x[i] for x in known], np.int64) for i in (0, 1))

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        """The row's own range, and the range whose guest it is, if any."""
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(firsts, x), max(len(firsts) - 1, 0))
        guest = np.where(none, host_of_null, np.where(firsts[at] == x, hosts[at], -1) if len(firsts) else -1)
        own, many = range_of(ids), 1 + (guest >= 0)
        flat = np.repeat(own, many)
        flat[(np.cumsum(many) - 1)[guest >= 0]] = guest[guest >= 0]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(flat.astype(np.int32)))

    rows = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("nth", "part")).select("doc_id", "text", "part", (F.col("nth") > 0).alias("guest"))
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_chars, name, name2, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. name and name2 are the halves of the text's digest.

    The edited text has the last third of the code points replaced by the first as many of the next document, downwards by doc_id (after
    the last: the first). A null text counts as empty; an empty text has a fingerprint of zeros, which is like another such one in full.
    Whole texts are embedded, in batches of bounded size. Repeated rows are followed by each other. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = neighbours(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Embedding(seed)

        def told(held: list[tuple]) -> pa.RecordBatch:
            edited, prints, changed = fingerprint_pairs([t for _, t, _ in held], model)
            own = np.array([not g for _, _, g in held[:-1]], bool)
            pick = np.flatnonzero(own)
            found = digests(held[i][1].encode() for i in pick)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([held[i][0] for i in pick], pa.int64()),
                "n_chars": pa.array([len(held[i][1]) for i in pick], pa.int64()),
                "name": pa.array(found[:, 0]),
                "name2": pa.array(found[:, 1]),
                "edited_sha256": pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in pick], pa.string()),
                "fingerprint": pa.array(_hex(prints[pick]), pa.string()),
                "edited_fingerprint": pa.array(_hex(changed[pick]), pa.string()),
                "near_edited": pa.array(likeness(prints[pick], changed[pick]), pa.float64()),
                "near_next": pa.array(likeness(prints[pick], prints[pick + 1]), pa.float64()),
            })

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].as_py()))
                size += len(held[-1][1])
                if (size > CHUNK or len(held) > CHUNK_TEXTS) and len(held) > 1:
                    yield told(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield told(held)

    return rows.mapInArrow(run, "doc_id long, n_chars long, name long, name2 long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def grams(text: str) -> np.ndarray:
    """All runs of GRAM code points of the whole text, as numbers, one for each run; a shorter text is one run."""
    x = symbols(text).astype(np.uint64)
    if not len(x):
        return x
    h, width = np.r_[x, np.zeros(max(0, GRAM - len(x)), np.uint64)], 1
    while width < GRAM:  # runs of twice the width from two of this one
        h = _mix(_mix(h[:-width]) ^ h[width:])
        width *= 2
    return h


def counted_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different ``grams``, sorted, and how often each occurs."""
    return np.unique(grams(text), return_counts=True)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The part of the longer text's ``counted_grams`` that both share, each as often as both have it; 1 if both texts are empty.

    One edit costs GRAM runs at most, so texts that are a 64th of their length apart by edit distance share three quarters.
    Linear but for sorting, so that texts of any length are verified whole.
    """
    (a, n), (b, m) = x, y
    most = max(n.sum(), m.sum())
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return float(np.minimum(n[i], m[j]).sum() / most) if most else 1.0


def cells_of(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), ">u2").reshape(len(prints), SAMPLES)


def likely_tree(names: list[int], prints: list[bytes]) -> list[tuple[int, int]]:
    """Of the pairs of a block whose fingerprints have LIKELY in common, a forest of those most alike, which connects what all would."""
    cells, n = cells_of(prints), len(prints)
    best, nearest, left = np.zeros(n), np.full(n, -1), np.ones(n, bool)
    found = []
    for _ in range(n):
        q = int(np.argmax(np.where(left, best, -1.0)))
        left[q] = False
        if best[q] >= LIKELY:
            found.append((names[nearest[q]], names[q]))
        near = likeness(cells, cells[q])
        closer = left & (near > best)
        best[closer], nearest[closer] = near[closer], q
    return found


def likely_ends(names: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
    """Each item of a block, with itself, that has LIKELY in common with one whose root, the first eight bytes of a body, differs."""
    roots, cells = np.array([b[:8].hex() for b in bodies]), cells_of([b[8:] for b in bodies])
    return [(x, x) for q, x in enumerate(names) if (likeness(cells[roots != roots[q]], cells[q]) >= LIKELY).any()]


def verified_rest(least: float) -> Callable[[list[int], list[bytes]], list[tuple[int, int]]]:
    """Links of a block between texts that are likely, overlap enough and aren't connected by then; a body is root, fingerprint, text."""

    def links(names: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
        root = np.unique(np.array([b[:8].hex() for b in bodies]), return_inverse=True)[1]
        cells = cells_of([b[8 : 8 + 2 * SAMPLES] for b in bodies])
        counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found = []

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in counted:
                counted[i] = counted_grams(bodies[i][8 + 2 * SAMPLES :].decode())
            return counted[i]

        for q in range(len(names) - 1):
            rest = np.flatnonzero(root[q + 1 :] != root[q]) + q + 1
            for x in rest[likeness(cells[rest], cells[q]) >= LIKELY].tolist():
                if root[x] != root[q] and overlap(of(q), of(x)) >= least:
                    found.append((names[q], names[x]))
                    root[root == root[x]] = root[q]
        return found

    return links


def near_links(members: DataFrame, held: DataFrame, docs: DataFrame, names: Names, least: float) -> DataFrame:
    """Links between texts of a block of ``members`` (lead, block, name) that are near; ``held`` (name, body) has their fingerprints.

    First the forest of the likeliest pairs of each block is verified. Then every other likely pair is, unless links connect it by then:
    so n copies of a text that all are near cost n verifications, and no pair is taken for near, or left out, by its fingerprints alone.
    For that the texts that still have such a pair go to their blocks, each once, and only links come out, fewer than a block has texts.
    """
    tree = materialise(blocks_met(members, held, likely_tree).distinct(), "prints-tree")
    links = verified_links(tree, docs, names, least)
    roots = components(links)
    rooted = materialise(members.join(roots.withColumnRenamed("node", "name"), "name", "left").select("lead", "block", "name", F.coalesce("root", "name").alias("root")), "prints-rooted")
    apart = materialise(rooted.groupBy("lead", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("lead", "block"), "prints-apart")
    members = rooted.join(apart, ["lead", "block"]).select("lead", "block", "name")
    heads = held.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", F.concat(F.unhex(F.lpad(F.hex(F.coalesce("root", "name")), 16, "0")), "body").alias("body"))
    ends = materialise(blocks_met(members, heads, likely_ends).select(F.col("a").alias("name")).distinct(), "prints-open")
    texts = texts_named(ends, docs, names)
    whole = heads.join(texts.withColumnRenamed("body", "text"), "name").select("name", F.concat("body", F.col("text").cast("binary")).alias("body"))
    rest = materialise(blocks_met(members.join(ends, "name", "left_semi"), whole, verified_rest(least)), "prints-rest")
    discard(tree, roots, rooted, apart, ends, texts)
    return links.union(rest)


def texts_named(ends: DataFrame, docs: DataFrame, names: Names) -> DataFrame:
    """(name, body): the texts of ``docs`` (text) that ``ends`` (name; a written table) names, each once."""
    wanted = Filter(ends)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            called = names.of(digests(t.encode() for t in texts))
            take = np.flatnonzero(wanted.may_hold(called))
            yield pa.RecordBatch.from_arrays([pa.array(called[take]), pa.array([texts[i] for i in take], pa.string())], names=["name", "body"])

    held = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(bodies, "name long, body string")
    return materialise(held.groupBy("name").agg(F.first("body").alias("body")), "prints-texts")


def verified_links(links: DataFrame, docs: DataFrame, names: Names, least: float) -> DataFrame:
    """Those of ``links`` (a, b; a written table) whose texts, from ``docs`` (text), overlap enough. A text is sent once for each link."""
    ends = materialise(links.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "prints-ends")
    held = texts_named(ends, docs, names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, counted_grams("")  # links of one text mostly follow each other
        for batch in batches:
            ok = []
            for i, (b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if b != last:
                    last, right = b, counted_grams(y)
                if overlap(counted_grams(x), right) >= least:
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(ok, pa.int64())) for c in (0, 1)], names=["a", "b"])

    both = links.join(held.toDF("a", "left"), "a").join(held.toDF("b", "right"), "b").select("a", "b", "left", "right")
    out = materialise(both.mapInArrow(near, "a long, b long"), "prints-verified")
    discard(ends, held)
    return out


def near_texts(prints: DataFrame, docs: DataFrame, least: float = NEAR, band: int = BAND, name_bits: int = 64) -> DataFrame:
    """(name, name2, near_root) of the different texts of ``prints`` (doc_id, n_chars, name, name2, fingerprint; a written table), which
    are those of ``docs`` (text), that have several rows or a near text.

    near_root is the smallest doc_id (null last) of the class: texts that agree in a band of ``band`` samples meet, those whose
    fingerprints have LIKELY in common are compared, and linked where their ``overlap`` is at least ``least``;
    classes are linked directly or through others. What isn't connected with the first of a group is held against all others, in blocks,
    so that a group of n that are alike costs n pairs, not its square. Null texts count as empty, and empty texts are equal.
    """
    keyed = prints.select(F.col("name").alias("name1"), "name2", "doc_id", "n_chars", "fingerprint", F.col("name").bitwiseAND(F.lit(int(Names(bits=name_bits).keep))).alias("name"))
    names, keyed = settled_names(keyed, name_bits)
    one = materialise(keyed.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.min("name1").alias("name1"), F.min("name2").alias("name2"), F.min("n_chars").alias("n_chars"), F.min("fingerprint").alias("fingerprint")), "prints")

    def entries() -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]:
        def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            called, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cells = np.frombuffer(bytes.fromhex("".join(batch.column(2).to_pylist())), ">u2").reshape(len(called), SAMPLES).astype(np.uint64)
            for i in range(0, SAMPLES, band):
                some = cells[:, i : i + band].any(1)
                key = np.full(int(some.sum()), i, np.uint64)
                for j in range(i, min(i + band, SAMPLES)):
                    key = _mix(key ^ cells[some, j])
                yield key, called[some], np.minimum(size[some], (1 << 31) - 1).astype(np.int32)

        return make

    rows = one.select("name", "n_chars", "fingerprint")
    found = candidate_groups(rows, entries, one.count() * -(-SAMPLES // band), np.zeros(0, np.uint64), lambda keys, sizes: np.full(len(keys), 2 * SAMPLES), int(100 * least))
    found = materialise(found, "prints-found")
    groups = materialise(leads(found), "prints-groups")
    discard(found)
    held = one.select("name", F.unhex("fingerprint").alias("body"))
    roots = connected(groups, lambda members: near_links(members, held, docs, names, least), "prints")
    classes = materialise(one.join(beside(roots), F.col("name") == F.col("node"), "left").where("rows > 1 or root is not null").select("name1", "name2", "doc_id", F.coalesce("root", "name").alias("root")), "prints-classes")
    firsts = materialise(classes.groupBy("root").agg(F.min("doc_id").alias("near_root")), "prints-roots")
    return materialise(classes.join(beside(firsts), "root").select(F.col("name1").alias("name"), "name2", "near_root"), "prints-near")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialise(fingerprint(docs), "fingerprints")
    near = near_texts(prints, docs).select(F.col("name").alias("_name"), F.col("name2").alias("_name2"), "near_root")
    columns = [c for c in prints.columns if not c.startswith("name")]
    return prints.join(beside(near), (F.col("name") == F.col("_name")) & (F.col("name2") == F.col("_name2")), "left").select(*columns, F.coalesce("near_root", "doc_id").alias("near_root"))

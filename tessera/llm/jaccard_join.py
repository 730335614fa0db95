"""Exact n-gram Jaccard self-join with token-group matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import beside, discard, fresh, materialise, table
from tessera.llm.grouping import U, Filter, Names, blocks_met, candidate_groups, connected, counted_keys, digests, hottest, leads, mix, settled_names

WORDS = 5
#: Documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bytes shingled at once.
CHUNK = 1 << 18
#: Bytes of a word that are hashed eight by eight; longer words are digested one by one.
LONG_WORD = 256
#: Tokens that two sets must share if no third set has them in its prefix: one may be chance.
SHARED = 4
#: A token in the prefixes of more different sets than this comes last in the order of tokens; at most so many tokens do (32 MB).
HOT, HOT_TOKENS = 2, 4_000_000
#: Sets of a group in the token-group matrix.
GROUP = 16


class Shingler:
    """Sets of hashed word n-grams of many texts at once.

    A word's hash takes its bytes eight by eight, each time mixed with what came before; a shingle's mixes those of its words. 64 bits
    stand for a shingle: two different ones in a pair of texts have the same with a chance of some 1e-19.
    """

    def __init__(self, words: int = WORDS):
        rng = np.random.Generator(np.random.Philox(7))
        self.words = words
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.factor = rng.integers(1, 1 << 63, words, dtype=np.uint64) | U(1)
        self.seed, self.step = (U(x) for x in rng.integers(1, 1 << 63, 2, dtype=np.uint64))
        self.mask = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def word_hashes(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words data[a:b]; eight bytes that belong to none follow the last."""
        size = b - a
        h = mix(size.astype(U) ^ self.seed)
        eight = np.arange(8)
        live = np.flatnonzero(size <= LONG_WORD)
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]].tobytes(), digest_size=8).digest(), "little")
        at, left = a[live], size[live]
        while len(live):
            piece = data[at[:, None] + eight].view(U).ravel() & self.mask[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ piece) * self.step + self.seed)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, and where each text's begin; text i is data[starts[i]:starts[i + 1]]."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        word = ~self.space[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = starts[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        w = self.word_hashes(np.r_[self.lower[data], np.zeros(8, np.uint8)], a, b)
        first = np.searchsorted(a, starts)
        count = np.diff(first)
        k = self.words
        spans = max(0, len(w) - k + 1)
        h = np.zeros(spans, np.uint64)
        for i in range(k):
            h += w[i : i + spans] * self.factor[i]
        text = np.repeat(np.arange(len(count)), count)
        inside = text[:spans] == text[k - 1 :] if spans else np.zeros(0, bool)
        h, owner = mix(h[inside]), text[:spans][inside]
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            short = count[few].astype(np.uint64)
            for i in range(k - 1):
                has = count[few] > i
                short[has] += w[first[few][has] + i] * self.factor[i]
            h, owner = np.r_[h, mix(short)], np.r_[owner, few]
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
        return h, np.searchsorted(owner, np.arange(len(count) + 1))

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text; none for nulls and texts without words."""
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK, "right")) - 1)
            h, cut = self.hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                s = np.sort(h[a:b])
                yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s
            i = j


def least_overlap(n: int, percent: int) -> int:
    """A set of n tokens shares at least so many with any set it links with."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The first tokens of the set, so many that two sets that link share SHARED of them, or their least overlap if that is less: hot
    tokens last, else by hash."""
    least = least_overlap(len(s), percent)
    p = len(s) - least + min(SHARED, least)
    if not len(hot):
        return s[:p]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    return np.r_[s[~is_hot][:p], s[is_hot]][:p]


def _sets_of(shingler: Shingler, names: Names, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The sets of each batch, those that this task hasn't met lately and that aren't empty, with their names."""
    seen: set[int] = set()
    for batch in batches:
        sets = [s for s in shingler.sets(batch.column(column)) if len(s)]
        called = names.of(digests(s.tobytes() for s in sets))
        fresh_ = []
        for i, me in enumerate(called.tolist()):
            if me not in seen:
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(me)
                fresh_.append(i)
        yield [sets[i] for i in fresh_], called[fresh_]


def set_table(docs: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """(doc_id, n, name, name2, keys) of each row's set: its size, both halves of its digest, and the packed tokens of its prefix, these
    once for each task that meets the set, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, names, none, seen = Shingler(words), Names(bits=bits), np.zeros(0, U), set()
        for batch in batches:
            sets = [*shingler.sets(batch.column(1))]
            found = digests(s.tobytes() for s in sets)
            first, keys = names.first(found), []
            for s, me in zip(sets, first.tolist(), strict=True):
                new = len(s) and me not in seen
                if new:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(me)
                keys.append(prefix(s, percent, none).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(found[:, 1]), pa.array(keys, pa.binary())], names=["doc_id", "n", "name", "name2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n long, name long, name2 long, keys binary")


def prefix_groups(docs: DataFrame, words: int, percent: int, last: np.ndarray, names: Names, n_entries: int) -> DataFrame:
    """Candidate groups of the sets of ``docs`` (text) by the tokens of their prefixes, ``last`` being the tokens that come last."""
    shared = docs.sparkSession.sparkContext.broadcast(last)  # at most HOT_TOKENS numbers

    def entries():
        shingler = Shingler(words)

        def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for sets, called in _sets_of(shingler, names, iter([batch]), 0):
                for s, me in zip(sets, called, strict=True):
                    p = prefix(s, percent, shared.value)
                    yield p, np.full(len(p), me, np.int64), np.full(len(p), len(s), np.int32)

        return make

    return candidate_groups(docs.select(F.coalesce("text", F.lit("")).alias("text")), entries, n_entries, last, lambda keys, sizes: 8 * sizes, percent, SHARED)


def links_within(names: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links among ``sets`` that join all that are connected; pairs that are connected already aren't compared.

    Token-group matrix: similar sets (by smallest token, then size) form groups of GROUP, each with the union of its tokens. For each set
    and group, the tokens shared with the union bound the overlap with any member; only groups that reach the least overlap are opened.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: (int(sets[i][0]), len(sets[i])))
    names, sets = [names[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(names[0], names[1])] if 100 * both >= percent * (sizes.sum() - both) else []
    universe, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.r_[0, np.cumsum(sizes)]
    groups = -(-n // GROUP)
    group_of = np.arange(n) // GROUP
    cells = np.unique(tokens.astype(np.int64) * groups + np.repeat(group_of, sizes))
    row, matrix = cells // groups, cells % groups
    row_at = np.searchsorted(row, np.arange(len(universe) + 1))
    root = np.arange(n)
    mark = np.zeros(len(universe), bool)
    found = []
    for q in range(n):
        if (root == root[0]).all():
            break
        mine = tokens[cut[q] : cut[q + 1]]
        lo, hi = row_at[mine], row_at[mine + 1]
        length = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        bound = np.bincount(matrix[at], minlength=groups)
        mark[mine] = True
        for g in np.flatnonzero(bound >= least_overlap(len(mine), percent)):
            a, b = g * GROUP, min(n, g * GROUP + GROUP)
            if (root[a:b] == root[q]).all():
                continue
            shared = np.add.reduceat(mark[tokens[cut[a] : cut[b]]].astype(np.int64), cut[a:b] - cut[a])
            linked = np.flatnonzero(100 * shared >= percent * (sizes[q] + sizes[a:b] - shared)) + a
            for x in linked:
                if root[x] != root[q]:
                    found.append((names[q], names[x]))
                    root[root == root[x]] = root[q]
        mark[mine] = False
    return found


def set_bodies(docs: DataFrame, wanted: Filter, words: int, names: Names) -> DataFrame:
    """(name, body) of the sets that ``wanted`` may hold; a set once for each task that meets it, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, called in _sets_of(Shingler(words), names, batches, 0):
            take = np.flatnonzero(wanted.may_hold(called))
            out, size = [], 0
            for j, i in enumerate(take):
                out.append(i)
                size += sets[i].nbytes
                if size > CHUNK or j == len(take) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(called[out]), pa.array([sets[x].tobytes() for x in out], pa.binary())], names=["name", "body"])
                    out, size = [], 0

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "name long, body binary")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, name_bits: int = 64) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Exact: no candidates are capped or sampled. Words are runs of other than ASCII white space, A-Z in lower case; a text of fewer words
    than a shingle is one shingle, a text without words (or null) has none and is a component of its own. Equal sets link, so repeated
    rows share a component; it is named by its smallest doc_id. A null doc_id never names a component unless all its ids are null.

    1. Each text becomes a set; equal sets are one from here on, known by a digest. 2. Sets that share a token of their prefixes (the
    tokens of which any partner has some) join the group of that token's smallest set; two sets that only the two of them share tokens
    with must share several, which the prefixes are long enough for, so that chance doesn't pair them. Tokens that occur in many prefixes
    are counted first and put last, so that widely shared passages don't gather unrelated texts. 3. Groups are verified in blocks of
    bounded size with token-group matrices. Of a group of several blocks, each block also holds the leader; what isn't connected with it
    after that is then held against every block. 4. Components of the links. ``name_bits`` shortens names (tests, to make them clash).
    """
    sets = materialise(set_table(docs, words, percent, name_bits), "jaccard-sets")
    n_entries = sets.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    counted = materialise(counted_keys(sets.where("keys is not null"), n_entries, HOT), "jaccard-counts")
    last = hottest(counted, HOT_TOKENS)
    names, called = settled_names(sets.where("n > 0"), name_bits)
    found = materialise(prefix_groups(docs, words, percent, last, names, n_entries), "jaccard-found")
    groups = materialise(leads(found), "jaccard-groups")
    discard(counted, found)
    bodies = set_bodies(docs, Filter(groups.select("name")), words, names)
    compare = lambda names, held: links_within(names, [np.frombuffer(x, U) for x in held], percent)
    roots = connected(groups, lambda members: blocks_met(members, bodies, compare), "jaccard")
    least = called.groupBy("name").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(least.join(roots, F.col("name") == F.col("node"), "left").where("rows > 1 or root is not null").select("name", "least", F.coalesce("root", "name").alias("root")), "jaccard-classes")
    ids = materialise(classes.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-ids")
    labels = materialise(classes.join(beside(ids), "root").select(F.col("name").alias("_name"), "component_id"), "jaccard-labels")
    out = called.join(beside(labels), F.col("name") == F.col("_name"), "left").select("doc_id", "n", "component_id").union(sets.where("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group, with its columns. Rows with a null doc_id stay, and
    of rows that repeat a doc_id all or none."""
    told = jaccard_components(docs.select("doc_id", "text"), words, percent)
    (gone_,) = fresh(docs.columns, "gone")
    gone = materialise(told.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_)).distinct(), "jaccard-gone")
    return docs.join(beside(gone), F.col("doc_id") == F.col(gone_), "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(seen) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""

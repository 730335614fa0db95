"""Sharding, exact dedup, mixing, packing and revisits against plain versions, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, mixing, packing, revisits, sharding

DOCS = "doc_id long, text string, source string, digest string, row_no long"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "x", 5) for i, t, s in rows], DOCS)


ROWS = [
    (1, "a b", "p"), (2, "a  b", "p"), (3, None, None), (4, "", "q"), (5, "a\tb", None), (6, "w " * 60_000, "q"), (7, "a b", "p"), (7, "a b", "p"),
    (8, "é c", "é"), (9, " ", "z"), (10, "a b", "p"), (None, "a b", "p"), (None, "only", "q"),
]


# -- sharding -------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, seed, inverse=True) == np.arange(n)).all()


def test_permutation_mixes():
    p = sharding.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05
    assert (p != sharding.permute(np.arange(10_000), 10_000, seed=1)).mean() > 0.99


def test_shards(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"té{i % 5}" * (i % 9)) for i in range(500)] + [(3, "again"), (3, "again"), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op2(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and got.shard.between(0, 15).all()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 16
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.size, r.text_crc32) for r in got.rename(columns={"size": "size_"}).rename(columns={"size_": "size"}).itertuples(index=False)) == want
    again = sharding.op2(spark, str(tmp_path)).toPandas()
    ordered = lambda x: x.sort_values(["shard", "slot"]).fillna(-1).values.tolist()
    assert ordered(got) == ordered(again)


def test_shards_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op2(spark, str(tmp_path)).count() == 0


# -- exact dedup ----------------------------------------------------------------------------------------------------------------------


def plain_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    rng = random.Random(4)
    rows = ROWS + [(100 + i, f"text {rng.randrange(40)}{' ' * rng.randrange(1, 3)}end", "s") for i in range(300)]
    rows += [((1 << 63) - 1, "last", "s"), ((1 << 63) - 1, "last", "s"), ((1 << 63) - 1, "ok", "s"), (None, "ok", "s"), (-5, "ok", "s")]
    frame = docs(spark, rows).withColumn("raw", F.lit(1)).withColumn("uid", F.lit(1)).withColumn("digest", F.lit(b"x")).repartition(5)
    got = exact_dedup.deduplicate(frame, digest_bytes=digest_bytes, memtable=40, fan_in=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_dedup(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_integers_of_any_width(spark):
    frame = spark.createDataFrame([(3, "a"), (2, "a"), (2, "a\t"), (4, "b"), (2, "a  ")], "doc_id int, text string")
    got = exact_dedup.deduplicate(frame).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter({(3, 2, 2): 1, (2, 2, 2): 3, (4, 4, 1): 1})
    assert sum(r.kept for r in got) == 3


def test_small_memtables(spark):
    rows = [(i, f"t{i % 50}", "s") for i in range(1000)]
    base = docs(spark, rows).selectExpr("doc_id", "doc_id AS uid", "unhex(sha2(text, 256)) AS digest").repartition(12)
    runs = common.materialise(exact_dedup.build_runs(base, 32, 8, memtable=10), "runs")
    assert runs.groupBy("range").count().agg(F.max("count")).first()[0] > 9  # more than three levels of three
    done = exact_dedup.compact(runs, 32, fan_in=3)
    assert done.groupBy("range").count().agg(F.max("count")).first()[0] == 1
    index = exact_dedup.entries_of(done, 32).toPandas()
    assert len(index) == 50 and (index.group_size == 20).all() and sorted(index.keep_id) == list(range(50)) == sorted(index.keep_uid)


def test_filters_miss_nothing():
    heads = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    packed = exact_dedup._filter(heads).tobytes()
    assert exact_dedup._maybe(packed, 500, heads).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert exact_dedup._maybe(packed, 500, others).mean() < 0.1


def test_dedup_of_nothing(spark):
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


# -- mixing ---------------------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        new = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not new:
            return target
        capped |= new


def test_mixing(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(2000)] + [(5000 + i, "long " * 900, "big") for i in range(30)] + [(9000, None, "tiny"), (9001, "one", "tiny")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op10(spark, str(tmp_path)).toPandas()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = plain_targets(dict(sizes))
    by_id = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got.itertuples(index=False):
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r[1]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (25 if s != "big" else 450), s
    again = mixing.op10(spark, str(tmp_path)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_bucket_size_changes_nothing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("aab")) for i in range(3000)]
    narrow = docs(spark, rows).select("doc_id", "source", mixing.word_count().alias("size"), mixing.draw_key().alias("key")).cache()
    a, b = (mixing.with_copies(narrow, mixing.plan(narrow, bucket_rows=n)).select("doc_id", "copies").toPandas().sort_values("doc_id").copies.tolist() for n in (20_000, 10))
    assert a == b


def test_mix_rows(spark):
    frame = docs(spark, [(1, "a b c", "x"), (2, "a", "y"), (3, None, "y"), (4, "", None)]).withColumn("copies", F.lit(1))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = Counter(r.doc_id for r in mixed.collect())
    assert got[1] <= 3 and got[2] == 3 == got[3]  # y is far below its share, and stops at three times its size
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "x"), (2, "", None)])).count() == 2  # no words: once


# -- packing --------------------------------------------------------------------------------------------------------------------------


def check_bins(pieces, capacities):
    bins = defaultdict(list)
    for p in pieces:
        if p.n_words:
            bins[p.bin_id].append(p)
    for own in bins.values():
        own.sort(key=lambda p: p.place)
        at = 0
        for p in own:
            assert p.place == at
            at += p.n_words
        assert len({p.bin_size for p in own}) == 1
        assert own[0].bin_size == min(c for c in capacities if c >= at)
    return bins


def test_packing_is_whole(spark):
    rng = random.Random(3)
    frame = docs(spark, [(i, "w " * rng.choice([0, 1, 30, 500, 513, 5000]), "s") for i in range(200)] + [(1, None, "s"), (7, "x y", "s"), (7, "x y", "s"), (None, "z", None)])
    pieces = packing.pack(frame).collect()
    assert check_bins(pieces, packing.CAPACITIES)
    words = defaultdict(list)
    for p in pieces:
        words[p.copy].append((p.start, p.n_words))
    assert len(words) == frame.count()
    for spans in words.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
    total = frame.select(mixing.word_count().alias("n")).groupBy().sum("n").first()[0]
    assert sum(p.n_words for p in pieces) == total
    assert packing.pack(docs(spark, [])).count() == 0


def plain_best_fit(lengths, capacity):
    room = []
    for n in lengths:
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, _, _ = packing.fit(lengths, (64,), 1)
    assert len(set(bins)) == plain_best_fit(lengths, 64)
    sizes = (16, 32, 64)
    bins, places, final = packing.pack_block(lengths, sizes, 2, 512)
    used = Counter()
    for b, p, n in zip(bins, places, lengths, strict=True):
        assert p == used[b]
        used[b] += n
    cost = sum(packing.cost_of(packing.least_holding(used[b], sizes), 2, 512) for b in used)
    assert all(f == packing.least_holding(used[b], sizes) for b, f in zip(bins, final, strict=True))
    assert cost <= min(packing.fit(lengths, sizes, 2, 512, w)[2] for w in (None, *sizes)) + 1e-9


def least_cost(lengths, sizes):
    """Over all ways to put the pieces into bins."""
    if not lengths:
        return 0.0
    first, rest = lengths[0], lengths[1:]
    best = math.inf
    for mask in range(1 << len(rest)):
        n = first + sum(x for i, x in enumerate(rest) if mask >> i & 1)
        if n <= sizes[-1]:
            best = min(best, packing.cost_of(packing.least_holding(n, sizes), 2, 512) + least_cost([x for i, x in enumerate(rest) if not mask >> i & 1], sizes))
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=6))
def test_packing_is_near_the_least_cost(lengths):
    sizes = (16, 32, 64)
    bins, _, final = packing.pack_block(sorted(lengths, reverse=True), sizes, 2, 512)
    cost = sum(packing.cost_of(c, 2, 512) for c in dict(zip(bins, final, strict=True)).values())
    assert least_cost(lengths, sizes) - 1e-9 <= cost <= 1.3 * least_cost(lengths, sizes)


@pytest.mark.parametrize("lengths", [
    [(37 * i) % 280 + 520 for i in range(3000)],
    [(37 * i) % 900 + 500 for i in range(3000)],
    [(53 * i) % 2500 + 600 for i in range(3000)],
    [700] * 500 + [1400] * 500 + [2700] * 300 + [90] * 400,
])
def test_sizes_that_compete_beat_any_one_size(lengths):
    lengths = sorted(lengths, reverse=True)
    jointly = packing.complete(lengths, packing.CAPACITIES)[2]
    assert all(jointly < packing.fit(lengths, packing.CAPACITIES, widest=c)[2] for c in packing.CAPACITIES)
    bins, _, final = packing.pack_block(lengths)
    assert sum(packing.cost_of(c) for c in dict(zip(bins, final, strict=True)).values()) <= jointly + 1e-6


def test_packing_does_not_depend_on_splits(spark):
    rows = [(i % 50, "w " * (i % 37), "s") for i in range(200)]
    one, other = (Counter(packing.pack(docs(spark, x).repartition(n)).collect()) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert one == other


# -- revisits -------------------------------------------------------------------------------------------------------------------------


def capture(i, url, ts, kind, **headers):
    return (i, url, ts, kind, {k.replace("_", "-"): v for k, v in headers.items()} or None, "extra")


CAPTURE = "record_id long, url string, ts long, kind string, headers map<string,string>, slice string"


def plain_resolve(rows, key):
    out = {}
    for i, url, ts, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        able = [r for r in rows if r[3] == "response" and url is not None and ts is not None and r[2] is not None and r[1] is not None and key[r[1]] == key[url] and r[2] < ts]
        if not able:
            out[i] = (None, "orphan")
            continue
        best = max(able, key=lambda r: (r[2], r[0]))
        theirs = best[4] or {}
        bare = lambda x: x.strip().removeprefix("W/")
        if "etag" in headers:
            ok = "etag" in theirs and bare(headers["etag"]) == bare(theirs["etag"])
        elif "last-modified" in headers:
            ok = headers["last-modified"] == theirs.get("last-modified")
        else:
            out[i] = (best[0], "unvalidated")
            continue
        out[i] = (best[0], "resolved" if ok else "mismatch")
    return out


def test_revisits(spark):
    rng = random.Random(6)
    urls = ["http://A.com/x/", "https://a.com:443/x", "http://a.com/x#f", "http://a.com/x?utm_source=q", "http://a.com/y?b=1&a=2", "http://a.com/y?a=2&b=1", "no scheme", None]
    key = dict(zip(urls, ["a.com/x"] * 4 + ["a.com/y?a=2&b=1"] * 2 + ["no scheme", None], strict=True))
    rows = []
    for i in range(600):
        ts = None if rng.random() < 0.02 else rng.randrange(300)
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        h = {}
        if rng.random() < 0.6:
            h["etag"] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.4:
            h["last_modified"] = rng.choice(["m", "n"])
        rows.append(capture(i, rng.choice(urls) if i % 50 else f"http://long.com/{'x' * 5000}", ts if i else 10**12, kind, **h))
    key[f"http://long.com/{'x' * 5000}"] = f"long.com/{'x' * 5000}"
    got = revisits.resolve(spark.createDataFrame(rows, CAPTURE), slice_rows=7).collect()
    want = plain_resolve(rows, key)
    assert {r.record_id: (r.response_id, r.status) for r in got} == want and len(got) == len(want)
    assert all((r.headers is not None) == (r.status == "resolved") for r in got)


def test_names_of_urls(spark):
    """Urls that name one thing meet, others don't; RFC 3986, 5.2.4 and 6.2."""
    same = [
        ("a.com/x", ["http://a.com/x", "HTTP://u:p@A.com:80/x/", "https://a.com:443/x#f", "http://a.com/b/../x", "http://a.com/./x/.", "http://a.com/../x", "http://a.com/%78"]),
        ("a.com:80/x", ["https://a.com:80/x"]), ("a.com:443/x", ["http://a.com:443/x"]), ("a.com:81/x", ["http://a.com:81/x"]), ("a:80", ["ftp://a:80"]),
        ("a.com/~u", ["http://a.com/~u", "http://a.com/%7Eu", "http://a.com/%7eu"]), ("a.com/%2F%E9%%4", ["http://a.com/%2f%e9%%4"]), ("a.com/a%20b?q=%26", ["http://a.com/a%20b?q=%26"]),
        ("a.com/...", ["http://a.com/..."]), ("a.com/x?a=..&b=/./", ["http://a.com/x?b=/./&a=..&utm_a=1"]), ("a.com", ["http://a.com", "http://a.com/", "http://a.com/..", "http://a.com//"]), ("a b", ["a b"]), (None, [None]),
    ]
    rows = [(u, want) for want, urls in same for u in urls]
    got = spark.createDataFrame(rows, "url string, want string").select("url", "want", revisits.canonical().alias("got")).collect()
    assert [(r.url, r.got) for r in got] == [(r.url, r.want) for r in got]


def test_merged_headers(spark):
    rows = [capture(1, "http://a/", 1, "response", etag='"1"', date="old", content_type="text/html", cache_control="a"), capture(2, "http://a/", 2, "revisit", etag='W/"1"', date="new", content_type="image/png", set_cookie="x")]
    got = revisits.resolve(spark.createDataFrame(rows, CAPTURE)).first()
    assert got.headers == {"etag": 'W/"1"', "date": "new", "content-type": "text/html", "cache-control": "a"}
    assert revisits.resolve(spark.createDataFrame([], CAPTURE)).count() == 0

"""Columns whose names the operators use themselves stay as they are; models at their shortest."""

import numpy as np
import pytest

from tessera.llm import filter_audit, hard_negatives, language_id, line_dedup, mixing, packing, personal_data, sharding, url_filter
from tessera.llm.language_id import ContextTrees

#: Every name that an operator gives to a column of its result, and some of those inside.
TAKEN = (
    "row_no place shard slot host path rule score verdict language spans found digest n kept keep_id group_size taken target size source_size capacity bin part mask cells "
    "_url _tie _at _part _n _start lines_removed removed times copy h row list label v low high kind votes features words offset sequence start length"
).split()


def documents(spark, wanted=("doc_id", "text", "lang", "source")):
    rows = [(i, "the cat sat on the mat and then it went away" + f" {i % 3}", "en", f"s{i % 2}") for i in range(12)] + [(12, None, None, None)]
    names = [c for c in TAKEN if c not in wanted]
    kinds = {"doc_id": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in wanted) + "".join(f", {c} string" for c in names)
    return spark.createDataFrame([(*r[: len(wanted)], *[f"{c}{r[0]}" for c in names]) for r in rows], schema), names


@pytest.mark.parametrize("use", [
    lambda d: sharding.shard(d, ["doc_id"]), language_id.identify, language_id.keep_identified, line_dedup.deduplicate_lines, mixing.mix, personal_data.redact,
    lambda d: url_filter.judge(d.withColumnRenamed("text", "url")),
], ids=["shard", "identify", "keep_identified", "deduplicate_lines", "mix", "redact", "judge"])
def test_columns_of_the_user_stay(spark, use):
    docs, names = documents(spark)
    before = {r["doc_id"]: tuple(r[c] for c in names) for r in docs.collect()}
    out = use(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows and all(tuple(r[c] for c in names) == before[r["doc_id"]] for r in rows)


@pytest.mark.parametrize("use", [lambda d: personal_data.find(d), lambda d: packing.pack(d), lambda d: filter_audit.audit(d, d.sparkSession.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, mask string"))], ids=["find", "pack", "audit"])
def test_operators_with_results_of_their_own(spark, use):
    docs, _ = documents(spark)
    plain = docs.select("doc_id", "text", "lang", "source")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(use(docs)) == key(use(plain))


def test_vectors(spark):
    rows = [(i, [float(i % 5), 1.0], i % 3, "x", "y", "z") for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string, v string, list string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(hard_negatives.mine(frame)) == key(hard_negatives.mine(frame.select("vec_id", "embedding", "label")))


def test_contexts_of_no_bytes():
    """Where the table has room for single bytes only, texts are scored by those."""
    texts = {"a": [b"aab" * 50], "b": [b"bbc" * 50]}
    for trees in (ContextTrees(texts, order=0), ContextTrees(texts, table_bytes=1)):
        assert trees.order == 0
        data = [b"aaaa", b"", b"bcbc"]
        bits = trees.lengths(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert bits[0].argmin() == 0 and bits[2].argmin() == 1 and not bits[1].any()

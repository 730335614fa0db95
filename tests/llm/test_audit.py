"""The filter audit against a plain count over all documents, with odd inputs."""

import re
from itertools import permutations

import duckdb
import pytest

from tessera.llm import filter_audit

COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs) else set())

    says = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    rows = [(lang or "", fails(i, text or ""), says(i, 1), says(i, 2)) for i, text, lang, *_ in docs]
    out, value = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for p in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(p):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                early = [r for r in mine if f in r[1] and r[1] & set(p[:k])]
                value[part, f] = value.get((part, f), 0) + len(gone)
                out.append((part, "".join(p), k + 1, len(left), len(gone), len(early), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, value[r[0], r[1][r[2] - 1]]) for r in out)


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, "a b", "en"), (2, "a b", "de"), (3, "a b", "en"), (3, "a b", "en"), (4, None, "en"), (5, "", None), (6, LONG, "en"), (7, LONG, "en"), (8, "w " * 60_000, "fr"),
    (9, LONG.upper(), "en"), (10, LONG + " 5%", ""), (11, LONG + "\x0b\t  x", "de"), (None, "a b", "en"), (None, "a b", "en"), (None, LONG, None), (12, " \t\r\n", "de"), (13, "É" * 300, "de"),
    (-4, LONG, "de"), (14, "A" + "é" * 33, "en"), (15, "A" + "é" * 32, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (6, 1, None), (8, 1, 1), (99, 1, 1), (None, 1, 1), (7, None, 1)]


def frames(spark, docs, labels):
    """With further columns whose names the operator uses itself."""
    d = spark.createDataFrame([(*r, 7, "x", 9) for r in docs], "doc_id long, text string, lang string, mask int, digest string, n long")
    return d, spark.createDataFrame([(*r, "x", 8) for r in labels], "doc_id long, quality int, toxic int, text string, part int")


def test_audit_is_the_plain_count(spark):
    got = filter_audit.audit(*frames(spark, DOCS, LABELS))
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == plain(DOCS, LABELS)


def test_audit_is_its_sql(spark, tmp_path):
    docs, labels = frames(spark, [r for r in DOCS if r[0] is not None], [r for r in LABELS if r[0] is not None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(COLS)} FROM ({filter_audit.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in filter_audit.op11(spark, str(tmp_path)).select(*COLS).collect()) == sorted(want)


@pytest.mark.parametrize("docs", [[], [(None, None, None)]])
def test_audit_of_little(spark, docs):
    got = filter_audit.audit(*frames(spark, docs, [])).select(*COLS).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, [])


def test_each_removal_has_one_filter(spark):
    """What the filters remove in turn and what they keep is every document, in each order; the shares of the filters add up to it too."""
    got = filter_audit.audit(*frames(spark, DOCS, LABELS)).toPandas()
    size = {p: sum((r[2] or "") == p for r in DOCS) for p in set(got.part)}
    for (part, _), x in got.groupby(["part", "filter_order"]):
        assert x.removed.sum() + x.sort_values("step").kept.iloc[-1] == size[part]
    for part, x in got.groupby("part"):
        once = x.drop_duplicates(x.columns[-1:].tolist() + ["filter_order", "step"])
        each = {o[s - 1]: v for o, s, v in zip(once.filter_order, once.step, once.shapley, strict=True)}
        assert sum(each.values()) == 120 * (size[part] - x[x.step == 5].kept.iloc[0])

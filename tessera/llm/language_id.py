"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import fresh, small_batches, table

#: Bytes of context at most; a longer one is tried first and escapes to shorter ones.
ORDER = 3
#: The training sample: documents of each language, documents in all, and bytes of a document that may be sampled.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_BYTES = 200, 6400, 20_000
#: Bytes of the table of code lengths, at most; where many languages would make it larger, contexts are shorter.
TABLE_BYTES = 256 << 20
#: Bytes scored at once.
CHUNK = 1 << 18
#: Documents whose language is less likely than this, given the texts' code lengths, are rejected by the filter.
SURE = 0.5
UNKNOWN = "und"


class ContextTrees:
    """Per-language byte context trees with frozen counts, laid out as one table of code lengths.

    Order k predicts a byte with c / (n + d) where it was seen c times in n after the last k bytes, d being the number of distinct bytes
    seen there, and otherwise escapes with d / (n + d) to order k - 1, where bytes seen at order k are excluded. Order -1 is uniform
    over the bytes of the sample and one symbol for all others. As the counts are frozen, the code length of a byte depends on the last
    ORDER bytes and the language only: ``node`` finds the longest context known to any language, ``bits[language][node, byte]`` has the
    exact length that the escapes add up to. The table takes at most ``table_bytes``: the order ends before the one that would go beyond.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES):
        self.langs, self.order = sorted(texts), order
        seen = np.unique(np.frombuffer(b"\n" + b"".join(b"".join(t) for t in texts.values()), np.uint8))
        self.size = a = len(seen) + 1
        self.symbol = np.zeros(256, np.int64)  # 0: never seen in training
        self.symbol[seen] = np.arange(1, a)
        self.pad = int(self.symbol[10])
        grams = []
        for lang in self.langs:
            parts = [self._shifted(*self._symbols(t)) for t in texts[lang]]
            grams.append([np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * (order + 1))
        levels = [np.full((1, a), 1.0 / a)] * len(self.langs)  # order -1
        known, tables = np.zeros(1, np.int64), []
        self.node = np.zeros(1, np.int32)
        base = 0
        for k in range(order + 1):
            codes = [self._code(g[1 : k + 1]) if k else np.zeros(len(g[0]), np.int64) for g in grams]
            mine = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
            mine = mine if k else np.zeros(1, np.int64)
            if k and (base + len(mine)) * a * len(self.langs) * 4 > table_bytes:
                self.order = k - 1
                break
            parent = np.searchsorted(known, mine % a ** max(k - 1, 0)) if k else np.zeros(1, np.int64)
            now = []
            for g, code, above in zip(grams, codes, levels, strict=True):
                at = np.searchsorted(mine, code) * a + g[0]
                c = np.bincount(at, minlength=len(mine) * a).reshape(len(mine), a).astype(float)
                now.append(self._ppm(c, above[parent]))
            node = np.tile(self.node, a) if k else np.zeros(1, np.int32)
            node[mine] = base + np.arange(len(mine))
            base += len(mine)
            self.node, known, levels = node, mine, now
            tables.append(now)
        self.bits = [(-np.log2(np.concatenate([t[i] for t in tables]))).astype(np.float32).ravel() for i in range(len(self.langs))]

    @staticmethod
    def _ppm(c: np.ndarray, above: np.ndarray) -> np.ndarray:
        n, d, seen = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True), c > 0
        rest = np.maximum(1.0 - (above * seen).sum(1, keepdims=True), 1e-12)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n == 0, above, np.where(seen, c / (n + d), d / (n + d) * above / rest))

    def _symbols(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.symbol[np.frombuffer(text, np.uint8)], np.array([0, len(text)])

    def _shifted(self, s: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The symbols, and those 1, 2, ... places before; before a text's start stands a line end."""
        out, sizes = [s], np.diff(starts)
        for k in range(1, self.order + 1):
            t = np.empty_like(s)
            t[k:] = s[: len(s) - k] if k < len(s) else s[:0]
            for j in range(k):
                t[(starts[:-1] + j)[sizes > j]] = self.pad
            out.append(t)
        return out

    def _code(self, before: list[np.ndarray]) -> np.ndarray:
        """Number of a context; its nearest byte counts least, so that the shorter context is the remainder."""
        code = before[-1]
        for x in reversed(before[:-1]):
            code = code * self.size + x
        return code

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; text i is data[starts[i]:starts[i + 1]]."""
        out = np.zeros((len(starts) - 1, len(self.langs)))
        a = 0
        while a < len(starts) - 1:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK, "right")) - 1)
            lo, hi = starts[a], starts[b]
            near = starts[a : b + 1] - lo
            full = np.flatnonzero(np.diff(near) > 0)
            if len(full):
                s = self._shifted(self.symbol[data[lo:hi]], near)
                context = self._code(s[1:]) if self.order else np.zeros(len(s[0]), np.int64)
                key = self.node[context].astype(np.int64) * self.size + s[0]
                for i, bits in enumerate(self.bits):
                    out[a + full, i] = np.add.reduceat(bits[key], near[:-1][full], dtype=np.float64)
            a = b
        return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty, and where each starts."""
    texts = texts.fill_null("").cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """A bounded sample of the labelled texts, as many of each language, by a hash of doc_id; held-out rows have no part in it.

    Texts of more than SAMPLE_BYTES take part, with so many of their bytes, only where a language has too few others. Of more than
    SAMPLE_ALL languages those with the most texts are learned, first by name where equal.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out() & (F.octet_length("text") > 0)).select("lang", "text", F.xxhash64("doc_id").alias("h"), (F.octet_length("text") > SAMPLE_BYTES).alias("long"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("long")).alias("short"))
    sizes = sizes.orderBy(F.col("all").desc(), "lang").limit(SAMPLE_ALL).collect()
    if not sizes:
        return {}
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(sizes)))
    of = lambda n: F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(n(r)))]), F.col("lang"))
    rate = lambda n, wanted: min(1.0, (4 * wanted + 50) / n) if n and wanted > 0 else 0.0
    share = F.when(F.col("long"), of(lambda r: rate(r["all"] - r["short"], each - r["short"]))).otherwise(of(lambda r: rate(r["short"], each)))
    few = usable.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).withColumn("text", F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES))
    best = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "text"))).where(F.col("n") <= each)
    out: dict[str, list[bytes]] = {}
    for r in best.select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(bytes(r["text"]).decode(errors="ignore").encode())  # a window can end inside a character
    return out


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with a last column ``language``, a struct: lang_pred, score, bits (of the whole text under the best model).

    Learns from ``labelled`` (doc_id, text, lang; ``docs`` if not given). The score is the posterior of the best language given the code
    lengths of the whole text under equal priors. A null text, a text without letters, and every text if nothing could be learned, get
    ``und`` and score 0. Equal code lengths go to the language first by name. If a column ``language`` is there already, the new one has
    underscores in front.
    """
    small_batches(docs.sparkSession)
    texts = training_sample(docs if labelled is None else labelled)
    model = docs.sparkSession.sparkContext.broadcast(ContextTrees(texts) if texts else None)  # bounded by the sample

    @F.arrow_udf("struct<lang_pred:string,score:double,bits:double>")
    def predict(text: pa.Array, lettered: pa.Array) -> pa.Array:
        trees = model.value
        lettered = lettered.fill_null(False).to_numpy(zero_copy_only=False)
        if trees is None:
            lettered = np.zeros(len(text), bool)
            bits = np.zeros((len(text), 1))
        else:
            bits = trees.lengths(*bytes_of(text))
        best = bits.argmin(1) if len(bits) else np.zeros(0, np.int64)
        least = bits[np.arange(len(bits)), best]
        score = 1.0 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
        names = np.array(trees.langs if trees else [UNKNOWN], dtype=object)[best]
        names[~lettered] = UNKNOWN
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(least)], names=["lang_pred", "score", "bits"])

    return docs.withColumn(fresh(docs.columns, "language")[0], predict("text", F.col("text").rlike(r"\p{L}")))


def keep_identified(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, and at least ``sure``. Columns stay as they are."""
    told = identify(docs)
    language = F.col(told.columns[-1])
    return told.where((language["lang_pred"] != UNKNOWN) & (language["score"] >= sure)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = identify(docs)
    return told.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.bits")

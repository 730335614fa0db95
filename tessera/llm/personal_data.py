"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how far each can be trusted, and a
classifier of spans is trained on what they say together."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise, small_batches, table

#: Kinds of spans, in their order. Those of the base patterns come first; names are found by the method alone.
KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = KINDS[:4]
EMAIL, IP, CARD, PHONE, NAME = range(5)
#: What a labeler says of a span.
ABSTAIN, YES, NO = range(3)
#: form: the kind's strict pattern. check: digits and parts add up. list: a gazetteer knows it. before, after: words beside it. edge: what it touches.
LABELERS = ("form", "check", "list", "before", "after", "edge")
#: Rounds of expectation-maximisation; each reliability starts as if so many votes had been right and one wrong.
ROUNDS, RIGHT = 60, 4.0
#: Different vote-and-feature rows of each kind that train the classifier, in expectation; weights; steps; and what a span needs to be added.
SAMPLE, WEIGHTS, STEPS, ACCEPT = 20_000, 1 << 14, 200, 0.8

# Gazetteers and cue words.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co eu uk de fr es it nl be ch at pl se no dk fi pt ie us ca mx br ar au nz jp cn in ru za".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "86", "91", "351", "353", "358")
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38")
GIVEN = frozenset(
    "Adam Alice Andrea Andrew Anna Anne Antonio Barbara Brian Carlos Carmen Charles Claire Claudia Daniel David Elena Elizabeth Emily Emma Eva Francois Frank George Hans "
    "Helen Henry Isabel Jack James Jane Javier Jean Jennifer John Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Klaus Laura Linda Lisa Lucas Luis Manuel Marc Maria "
    "Marie Mark Martin Mary Matthew Michael Miguel Nicolas Nina Oliver Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Richard Robert Rosa Sarah Simon Sophie Stefan "
    "Susan Thomas Ursula Veronica William Wolfgang".split()
)
CUES = (
    "email e-mail mail mailto correo courriel contact write kontakt",
    "ip ipv4 ipv6 host server address addr login from",
    "card visa mastercard amex credit debit karte carte tarjeta kreditkarte",
    "phone tel telephone call mobile cell fax telefon telefono téléphone whatsapp dial ring",
    "name mr mrs ms dr prof dear herr frau monsieur madame señor señora sincerely signed",
)
AGAINST = (
    "package version",
    "version v release section chapter build",
    "order invoice isbn serial tracking token ticket id",
    "order invoice isbn serial version date between pages page from year price",
    "street saint st avenue river mount university",
)
AFTER = ("write reply", "port logged connected", "exp expires cvv cvc valid", "ext extension mobile office", "phd jr esq lives wrote")
CUES, AGAINST, AFTER = (tuple(frozenset(x.split()) for x in xs) for xs in (CUES, AGAINST, AFTER))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN_RE = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_RE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match starts a run of digits, whatever is tried
CARD_RE = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE_RE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT_RE = re.compile(r" ?[\[({<] ?at ?[\])}>] ?| at ", re.I)
DOTS_RE = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)[A-Za-z0-9-]++)++", re.I)
IPV6_RE = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOCAL_PHONE_RE = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9])")
NAME_RE = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?= [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
SECOND_RE = re.compile(r"(?: [A-Z]\.)? [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++")
DATE_RE = re.compile(r"(?:[0-9]{4}[-./][0-9]{2}[-./][0-9]{2}|[0-9]{2}[-./][0-9]{2}[-./][0-9]{4})")
DIGITS = re.compile(r"[^0-9]+")


def small(part: str) -> bool:
    """Whether a run of digits is at most 255, however long it is."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def run_before(text: str, end: int, least: int) -> int:
    """Where the run of local characters that ends at ``end`` starts, ``least`` or later."""
    while end > least and text[end - 1] in LOCAL:
        end -= 1
    return end


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it holds) of the base patterns' leftmost matches, in time proportional to the text.

    A mail address is looked for from its sign: the longest run before it is where the leftmost match starts.
    """
    after, at = 0, text.find("@")
    while at >= 0:
        start = run_before(text, at, after)
        if start < at and (m := DOMAIN_RE.match(text, at + 1)):
            yield EMAIL, start, m.end(), True
            after = m.end()
        at = text.find("@", max(at + 1, after))
    for m in IP_RE.finditer(text):
        yield IP, *m.span(), all(small(p) for p in m.group().split("."))
    for m in CARD_RE.finditer(text):
        if m.end() - m.start() >= 12:
            digits = DIGITS.sub("", m.group())
            yield CARD, *m.span(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE_RE.finditer(text):
        yield PHONE, *m.span(), 9 <= len(DIGITS.sub("", m.group())) <= 15


def further(text: str) -> Iterator[tuple[int, int, int]]:
    """Wider candidates: spelt-out mail addresses, IPv6, numbers without a country's code, and names."""
    for m in AT_RE.finditer(text):
        start = run_before(text, m.start(), 0)
        rest = DOTS_RE.match(text, m.end())
        if start < m.start() and rest and (m.group() != " at " or " dot " in rest.group().lower()):
            yield EMAIL, start, rest.end()
    for m in IPV6_RE.finditer(text):
        yield IP, *m.span()
    for m in LOCAL_PHONE_RE.finditer(text):
        if 7 <= len(DIGITS.sub("", m.group())) <= 15:
            yield PHONE, *m.span()
    for m in NAME_RE.finditer(text):
        if m.group() in GIVEN or (w := words_before(text, m.start())) and w[-1] in CUES[NAME]:
            yield NAME, m.start(), SECOND_RE.match(text, m.end()).end()


def words_before(text: str, at: int) -> list[str]:
    """The last three words of the 64 characters before, small and without signs at their ends; ``text`` itself may be cut in a word."""
    return [w for x in text[max(0, at - 64) : at].lower().split()[-3:] if (w := x.strip(".,:;!?()[]\"'#"))]


def words_after(text: str, at: int) -> list[str]:
    return [w for x in text[at : at + 48].lower().split()[:2] if (w := x.strip(".,:;!?()[]\"'#"))]


def votes_of(kind: int, text: str, start: int, end: int, holds: bool | None) -> list[int]:
    """What each labeler says. ``holds``: of a match of the base pattern, whether it is base; None of a wider candidate."""
    span, digits = text[start:end], DIGITS.sub("", text[start:end])
    before, after = words_before(text, start), words_after(text, end)
    form = ABSTAIN if holds is None else YES if holds else NO
    if kind == EMAIL:
        last = re.split(r"[^a-z]+", span.lower())[-1]
        check = YES if 2 <= len(last) <= 24 else NO
        known = YES if last in TOP_LEVEL else ABSTAIN
    elif kind == IP:
        parts = span.split(".")
        check = YES if ":" in span or all(small(p) and (p == "0" or p[0] != "0") for p in parts) else NO
        known = ABSTAIN if ":" in span else NO if parts[0] == "0" else YES
    elif kind == CARD:
        check = YES if 12 <= len(digits) <= 19 and luhn(digits) else NO
        known = YES if digits.startswith(ISSUERS) else ABSTAIN
    elif kind == PHONE:
        check = NO if not 7 <= len(digits) <= 15 or DATE_RE.fullmatch(span) else YES if holds else ABSTAIN
        known = YES if span[0] == "+" and digits.startswith(CALLING) else ABSTAIN
    else:
        first, *_, second = span.split(" ")
        check = NO if second in GIVEN and first not in GIVEN else ABSTAIN
        known = YES if first in GIVEN else ABSTAIN
    cue = NO if set(before) & AGAINST[kind] else YES if set(before) & CUES[kind] else ABSTAIN
    later = YES if set(after) & AFTER[kind] else ABSTAIN
    touch = text[max(0, start - 1) : start] + text[end : end + 1]
    edge = NO if any(c.isalnum() or c in "_/=#" for c in touch) else ABSTAIN
    return [form, check, known, cue, later, edge]


def shape(span: str) -> str:
    """Digits as 9, small letters as a, capitals as A; runs once; at most 24 signs of it."""
    out = re.sub(r"[0-9]+", "9", span)
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group()[0].isupper() else "a", out)
    return out[:24]


def features_of(kind: int, text: str, start: int, end: int, votes: list[int]) -> list[int]:
    """Places of the weights that speak for or against a span: votes, shape, length, the words and the characters beside it."""
    before, after = words_before(text, start), words_after(text, end)
    said = [f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True)]
    said += [f"shape={shape(text[start:end])}", f"length={min(end - start, 40) // 4}", f"last={before[-1] if before else ''}", f"next={after[0] if after else ''}"]
    said += [f"left={text[max(0, start - 1):start]}", f"right={text[end:end + 1]}", "all"]
    return sorted({zlib.crc32(f"{KINDS[kind]}|{s}".encode("utf-8", "surrogatepass")) % WEIGHTS for s in said})


#: A candidate: kind, start, end, whether it is base, votes as one number to base three, features.
Candidate = tuple[int, int, int, bool, int, list[int]]
FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])


def candidates(text: str | None) -> list[Candidate]:
    """Base spans, matches of the base patterns that don't hold, and wider candidates that touch no base span."""
    text = text or ""
    seen = list(matches(text))
    base = sorted((s, e) for _, s, e, holds in seen if holds)
    starts = np.array([s for s, _ in base], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in base], np.int64)) if base else starts

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(starts, e))  # base spans that start before e
        return not k or int(reach[k - 1]) <= s

    wider = [(k, s, e, None) for k, s, e in further(text)]
    out = []
    for kind, s, e, holds in seen + wider:
        if holds or free(s, e):
            votes = votes_of(kind, text, s, e, holds)
            code = sum(v * 3**k for k, v in enumerate(votes))
            out.append((kind, s, e, bool(holds), code, features_of(kind, text, s, e, votes)))
    return out


def votes_in(codes: np.ndarray) -> np.ndarray:
    """A row of votes for each code."""
    return codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over rows of ``votes`` that occur ``n`` times: how likely each row is personal data, and for each class (not,
    is) and labeler how often it says yes and no where it doesn't abstain. To abstain is no evidence: a pattern that is silent on all
    candidates of some make would else speak against them. The start, a majority, and the prior keep the classes from changing places.
    """
    yes, no = (votes == YES).sum(1), (votes == NO).sum(1)
    p = np.where(yes > no, 0.9, np.where(yes < no, 0.1, 0.5))
    seen = np.stack([votes == v for v in (YES, NO)], 2).astype(float)
    prior = np.array([[1.0, RIGHT], [RIGHT, 1.0]])
    said = np.zeros((2, votes.shape[1], 2))
    for _ in range(rounds):
        for z, w in enumerate((n * (1 - p), n * p)):
            said[z] = np.einsum("m,mlv->lv", w, seen) + prior[z]
        said /= said.sum(2, keepdims=True)
        share = (n @ p + 1) / (n.sum() + 2)
        odds = np.log(share) - np.log(1 - share) + np.einsum("mlv,lv->m", seen, np.log(said[1]) - np.log(said[0]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, said


def trained(rows: list[list[int]], target: np.ndarray, n: np.ndarray, steps: int = STEPS, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by full steps of Adagrad."""
    weights, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    if rows:
        at = np.concatenate([np.array(r, np.int64) for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        share = n / n.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, weights[at], len(rows)), -30, 30)))
            slope = np.bincount(at, (share * (p - target))[of], WEIGHTS) + decay * weights
            seen += slope**2
            weights -= rate * slope / np.sqrt(seen)
    return weights


@dataclass
class Model:
    """Weights of the span classifier; for each kind, how often the labelers say what of each class; how likely each vote is right."""

    weights: np.ndarray
    said: dict[str, np.ndarray]
    posterior: dict[tuple[int, int], float]

    def chosen(self, found: list[Candidate]) -> list[tuple[int, int, int, bool, float]]:
        """(kind, start, end, base, likelihood) in order: base spans, and the likeliest others that overlap nothing taken before."""
        taken, spans = [], [(k, s, e, True, 1.0) for k, s, e, base, _, _ in found if base]
        likely = [(1 / (1 + np.exp(-self.weights[f].sum())), k, s, e) for k, s, e, base, _, f in found if not base]
        for p, k, s, e in sorted((x for x in likely if x[0] >= ACCEPT), key=lambda x: (-x[0], x[2], x[1])):
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                spans.append((k, s, e, False, float(p)))
        return sorted(spans, key=lambda x: (x[1], x[0], x[2]))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row's doc_id and its candidates (``found``), without its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [FOUND.field(i).name for i in range(FOUND.num_fields)]
        for b in batches:
            found = pa.array([[dict(zip(names, c, strict=True)) for c in candidates(t.as_py())] for t in b.column(1)], pa.list_(FOUND))
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, found array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(scan, schema)


def learn(found: DataFrame) -> Model:
    """Reliabilities from the votes on every candidate of ``found`` (a histogram of at most 729 rows a kind), and a classifier trained on
    what they make of some SAMPLE different candidates of each kind, drawn by hash; equal candidates are one with their number."""
    each = found.select(F.inline("found"))
    name = F.xxhash64("kind", "votes", "features")
    seen = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(name).alias("distinct")).collect()
    posterior, said, share = {}, {}, [0.0] * len(KINDS)
    for kind in range(len(KINDS)):
        rows = sorted((r["votes"], r["n"], r["distinct"]) for r in seen if r["kind"] == kind)
        if rows:
            codes, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
            p, said[KINDS[kind]] = reliabilities(votes_in(codes), n)
            posterior |= {(kind, int(c)): float(x) for c, x in zip(codes, p, strict=True)}
            share[kind] = min(1.0, SAMPLE / max(1, sum(r[2] for r in rows)))
    most = F.element_at(F.lit([int(s * (1 << 30)) for s in share]), F.col("kind") + 1)
    drawn = each.where(F.pmod(name, F.lit(1 << 30)) < most).groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    sample = sorted((r["kind"], r["votes"], list(r["features"]), r["n"]) for r in drawn.collect())
    target, n = np.array([posterior[k, v] for k, v, _, _ in sample]), np.array([float(r[3]) for r in sample])
    return Model(trained([f for _, _, f, _ in sample], target, n), said, posterior)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): a row for each row of ``docs`` (doc_id, text), in which ``spans`` are (kind, start, end, base, likelihood) in code
    points, ends exclusive, by start and kind.

    A null text is an empty one and has no spans. Rows without doc_id or with the same one are rows of their own. Time and memory follow the
    text: every pattern runs along it once. Base spans always stay; others are added where the classifier finds them ACCEPT likely and they
    overlap none. Of no rows, or rows without candidates, nothing is learnt and nothing added. Other columns are not read.
    """
    found = materialise(scanned(docs), "personal-found")
    model = learn(found)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("likelihood", pa.float64())]))
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "likelihood"), (KINDS[k], *rest), strict=True)) for k, *rest in model.chosen([tuple(c.values()) for c in x])] for x in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    out = "spans array<struct<kind:string,start:int,end:int,base:boolean,likelihood:double>>"
    return found.mapInArrow(choose, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {out}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; spans that overlap are one, under the first one's kind.
    All columns stay; a null text stays null."""
    spark = docs.sparkSession
    found = materialise(scanned(docs), "personal-found")
    model = learn(found)
    discard(found)
    small_batches(spark)

    def without(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, start, end, _, _ in model.chosen(candidates(text)):
            if start >= at:
                out += [text[at:start], f"<{KINDS[kind]}>"]
            at = max(at, end)
        return "".join(out) + text[at:]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = b.schema.get_field_index("text")
            new = pa.array([without(t.as_py()) for t in b.column(where)], b.schema.field(where).type)
            yield pa.RecordBatch.from_arrays([new if i == where else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find`` over documents: numbers and digest of the base spans, all spans as text, and how many the method added (``n_added``)."""
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    out = found.withColumn("base", base)
    return out.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))

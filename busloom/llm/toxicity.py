"""Toxicity by multiple-instance learning.

Only documents have labels; sentences are the instances. A sentence is toxic with probability p = logistic(b + sum of the
weights of its features), and a document with P = 1 - product(1 - p) over its sentences (noisy-or). The weights are fitted
to the document labels by likelihood, and then tell which sentences offend. Features are words and word beginnings, so the
text is the only input of a score; a word counts by the one of its features that has the best evidence. Each weight is drawn
towards what its evidence alone would give: the lower bound (DOUBT standard errors) of the share of toxic documents among those
with the feature. GAIN, DOUBT and DECAY were chosen by cross-validation among the rows that are learned from.

The classifier is fitted on at most MAX_PER_CLASS labelled documents of either label, those with the smallest hash of the
id, as far as they have MAX_CLASS_BYTES of text together; each class weighs as much as all its labelled ids (held-out ones aside).
Everything else reads all rows. The texts of the sample stay on the executors: tasks count their features, and once it is known which
of these tell, tasks leave of each text the words that do, by sentence; the driver gets these alone and fits the weights. Labelled ids with crc32(id) mod 3 = 1 are held out. Null labels and ids are not learned
from; an id with several labels counts as toxic if half of them say so; one with several texts is learned by its smallest
text, and equal texts once. Without labelled toxic documents all scores are the (small) base rate. A null or empty text scores as one sentence
without evidence. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, checkpointed, map_texts, pieces, smallest

MAX_PER_CLASS = 3000
MAX_CLASS_BYTES = 64 << 20
#: How much a feature must tell at least (twice its log-likelihood ratio), how many standard errors its share is doubted by, and how
#: strongly a weight is held to its evidence.
GAIN, DOUBT, DECAY = 15.0, 1.0, 0.1
#: How many features may pass by chance, among all that are looked at: the more there are, the more each must tell.
BY_CHANCE = 0.5
_BIAS = -7.0
THRESHOLD = 0.7
#: Lengths of the word beginnings that are features, in code points; the word goes on after them.
PREFIXES = range(3, 11)
_END = re.compile(r"[.!?\n]")
#: Word bytes after lower-casing, line feeds for the ends of sentences, and spaces for the rest.
_BYTES = bytes(10 if chr(i) in ".!?\n" else b for i, b in enumerate(WORD_BYTES))
_CACHE = 200_000
#: Tasks that read the sample, at most, and features that one of them counts before it passes them on.
_LANES, _COUNTED = 32, 200_000


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) > k)]


def plain(text: str) -> bytes:
    """The words of a text, with a line feed between sentences."""
    return text.encode("utf-8", "replace").translate(_BYTES)


class Model:
    """weights: the evidence and the weight of each feature."""

    def __init__(self, bias: float, weights: dict[str, tuple[float, float]]) -> None:
        self.bias, self.weights = bias, weights
        self.seen: set[bytes] = set()  # words met lately, and what tells of those that tell anything
        self.telling: dict[bytes, str] = {}
        self.starts = {f.removeprefix("=").encode()[:3] for f in weights}  # a word that starts otherwise tells nothing

    def feature(self, word: bytes) -> str | None:
        """The feature of a word with the best evidence; of equal ones the longest."""
        weights, best = self.weights, None
        for f in features(word):  # the whole word first, then beginnings from short to long
            if f in weights and (best is None or weights[f][0] > weights[best][0] or weights[f][0] == weights[best][0] and (len(f), f) > (len(best), best)):
                best = f
        return best

    def _meet(self, words: set[bytes]) -> bool:
        """Whether any of the words tells something; new words are looked at once."""
        new = words - self.seen
        if len(self.seen) + len(new) > _CACHE:
            self.seen.clear()
            self.telling.clear()
            new = words
        starts = self.starts
        for w in [w for w in new if w[:3] in starts]:
            if got := self.feature(w):
                self.telling[w] = got
        self.seen |= new
        return not words.isdisjoint(self.telling)

    def heard(self, raw: bytes) -> tuple[int, list[tuple[int, set[bytes]]]]:
        """How many sentences a text has, empty ones included, and the words that tell of those that have any, by number."""
        words = set(raw.split())
        slots = 1 + raw.count(b"\n")
        if not self._meet(words):
            return slots, []
        hits = words & self.telling.keys()
        found = []
        for i, part in enumerate(raw.split(b"\n")):
            if not hits.isdisjoint(own := part.split()):
                found.append((i, hits.intersection(own)))
        return slots, found

    def told(self, raw: bytes) -> tuple[int, list[tuple[int, set[str]]]]:
        """The same with features in place of words."""
        slots, found = self.heard(raw)
        return slots, [(i, {self.telling[w] for w in own}) for i, own in found]

    def score(self, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """P of a text, and its sentences with p of at least least: start, end (code points) and p."""
        text = text or ""
        slots, told = self.told(plain(text))
        log_none, offending = 0.0, []
        for i, got in told:
            z = self.bias + sum(self.weights[f][1] for f in sorted(got))
            log_none -= max(z, 0) + math.log1p(math.exp(-abs(z)))
            if (p := 1 / (1 + math.exp(-max(-500.0, z)))) >= least:
                offending.append((i, p))
        log_none -= (slots - len(told)) * math.log1p(math.exp(self.bias))
        ends = [-1, *(m.start() for m in _END.finditer(text)), len(text)] if offending else []
        return 1 - math.exp(log_none), [(ends[i] + 1, ends[i + 1], p) for i, p in offending]


def _lower(share: float, n: int, doubt: float) -> float:
    """Wilson's lower bound of a share seen in n documents."""
    d = doubt * doubt / n
    return (share + d / 2 - math.sqrt(d * (share * (1 - share) + d / 4))) / (1 + d)


def _tells(a: int, b: int, n1: int, n0: int, weights: tuple[float, float], gain: float, doubt: float) -> float | None:
    """The lower bound of the share of toxic documents among those with a feature (a toxic and b clean ones), if it tells enough."""
    if a < 3 or a / n1 < 4 * b / max(n0, 1):
        return None
    rate = n1 / (n1 + n0)
    # what a feature tells, and how sure that is, is a matter of the texts at hand; what they stand for only moves the odds
    share = a / (a + b)
    if 2 * (a * math.log(share / rate) + (b * math.log((1 - share) / max(1 - rate, 1e-9)) if b else 0.0)) < gain:
        return None
    low = _lower(share, a + b, doubt)
    return low * weights[1] / (low * weights[1] + (1 - low) * weights[0])


def _counted(texts: DataFrame) -> DataFrame:
    """f, a and b: how many toxic and how many clean ones of the texts (t, y) have a feature, for features of at least three toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def passed_on() -> Iterator[pa.RecordBatch]:
            for y, own in enumerate(counts):
                n = pa.array(own.values(), pa.int64())
                none = pa.array(np.zeros(len(n), np.int64))
                for b in pieces([pa.RecordBatch.from_arrays([pa.array(own, pa.string()), n if y else none, none if y else n], ["f", "a", "b"])], 1 << 14):
                    yield b
                own.clear()

        for batch in pieces(batches):
            for t, y in zip(batch.column(0), batch.column(1), strict=True):
                counts[y.as_py()].update({f for w in set(plain(t.as_py()).split()) for f in features(w)})
                if len(counts[0]) + len(counts[1]) > _COUNTED:
                    yield from passed_on()
        yield from passed_on()

    return texts.select("t", "y").mapInArrow(run, "f string, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a >= 3")


def _first(counted: DataFrame, n1: int, n0: int, weights: tuple[float, float], gain: float, doubt: float) -> dict[str, float]:
    """The evidence of the features that tell enough, when all features of a word count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [_tells(a.as_py(), b.as_py(), n1, n0, weights, gain, doubt) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e, pa.float64())], ["f", "e"]).filter(pa.array([x is not None for x in e], pa.bool_()))

    return dict(sorted((r.f, r.e) for r in counted.select("f", "a", "b").coalesce(_LANES).mapInArrow(run, "f string, e double").collect()))


def _heard(texts: DataFrame, found: dict[str, float]) -> list[tuple[bytes, int, int]]:
    """What is left of each text (t, y): the words that tell, a line for each sentence that has any; how many sentences it has; its label.

    In an order that depends on the texts alone. Words that tell are few, as they are rare in clean texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Model(_BIAS, {f: (e, 0.0) for f, e in shared.value.items()})
        for batch in pieces(batches):
            got = [reader.heard(plain(t.as_py())) for t in batch.column(0)]
            lines = [b"\n".join(b" ".join(sorted(own)) for _, own in told) for _, told in got]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array([n for n, _ in got], pa.int64()), batch.column(1), batch.column(2)], ["left", "slots", "y", "h"])

    rows = texts.select("t", "y", F.xxhash64("t").alias("h")).mapInArrow(run, "left binary, slots bigint, y int, h bigint").collect()
    return [(left, slots, y) for _, left, slots, y in sorted((r.h, bytes(r.left), r.slots, r.y) for r in rows)]


def _settled(found: dict[str, float], rows: list[tuple[bytes, int, int]], n1: int, n0: int, weights: tuple[float, float], gain: float, doubt: float) -> dict[str, float]:
    """The evidence when each word counts for its best feature alone, until no feature leaves: a beginning isn't to get its
    evidence from one word that tells by itself."""
    words = [set(left.split()) for left, _, _ in rows]
    for _ in range(5):
        reader = Model(_BIAS, {f: (e, 0.0) for f, e in found.items()})
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for own, (_, _, y) in zip(words, rows, strict=True):
            reader._meet(own)
            counts[y].update({reader.telling[w] for w in own & reader.telling.keys()})
        left = {f: e for f, a in sorted(counts[1].items()) if (e := _tells(a, counts[0][f], n1, n0, weights, gain, doubt)) is not None}
        if left.keys() == found.keys():
            return left
        found = left
    return found


def fit(texts: DataFrame, rounds: int = 300, decay: float = DECAY, weights: tuple[float, float] = (1.0, 1.0), gain: float = GAIN, doubt: float = DOUBT) -> Model:
    """The noisy-or model of labelled texts (t, y), each once. weights: how many labelled documents a clean and a toxic text stands for."""
    n = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n1:
        return Model(math.log(0.01), {})
    counted = checkpointed(_counted(texts))
    gain = max(gain, 2 * math.log(max(counted.count(), 1) / BY_CHANCE))
    found = _first(counted, n1, n0, weights, gain, doubt)
    rows = _heard(texts, found)
    found = _settled(found, rows, n1, n0, weights, gain, doubt)
    reader = Model(_BIAS, {f: (e, 0.0) for f, e in found.items()})
    kept = {f: i for i, f in enumerate(found)}
    drawn = np.array([max(0.0, math.log(e / (1 - e)) - _BIAS) for e in found.values()])
    sent_doc, feat_sent, feat_id = [], [], []
    silent = np.zeros(len(rows))
    y = np.array([r[2] for r in rows], dtype=float)
    for d, (left, slots, _) in enumerate(rows):
        _, told = reader.told(left)
        for _, got in told:
            feat_sent += [len(sent_doc)] * len(got)
            feat_id += sorted(kept[f] for f in got)
            sent_doc.append(d)
        silent[d] = slots - len(told)
    sent_doc, feat_sent, feat_id = (np.array(x, dtype=np.int64) for x in (sent_doc, feat_sent, feat_id))
    weight = np.where(y > 0, weights[1], weights[0])
    weight *= len(rows) / weight.sum()  # the decay is against as many rows as there are
    theta = np.concatenate([[_BIAS], drawn])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):  # Adam on the mean negative log-likelihood
        z = theta[0] + np.bincount(feat_sent, theta[1:][feat_id], len(sent_doc)) if len(sent_doc) else np.zeros(0)
        none = np.bincount(sent_doc, np.logaddexp(0, z), len(rows)) + silent * np.logaddexp(0, theta[0])
        big = np.maximum(-np.expm1(-none), 1e-12)
        push = weight * np.where(y > 0, -np.exp(-none) / big, 1.0)
        gs = push[sent_doc] / (1 + np.exp(-z)) if len(sent_doc) else z
        g = np.concatenate([[gs.sum() + (push * silent).sum() / (1 + np.exp(-theta[0]))], np.bincount(feat_id, gs[feat_sent], len(kept)) if len(kept) else []])
        g[1:] += decay * (theta[1:] - drawn)
        g /= len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[0]), {f: (found[f], max(0.0, float(theta[1 + i]))) for f, i in kept.items()})


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_class_bytes: int = MAX_CLASS_BYTES) -> Model:
    ids = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).filter("k is not null and y is not null").groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")).filter(~held_out("k"))
    ids = checkpointed(ids)
    n = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    picked = smallest(ids.filter("y = 1"), "k", max_per_class, n.get(1, 0)).unionAll(smallest(ids.filter("y = 0"), "k", max_per_class, n.get(0, 0)))
    texts = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), "k")  # 2 * max_per_class rows at most
    texts = checkpointed(texts.groupBy("k", "y").agg(F.min("t").alias("t")))
    # texts of over a sixteenth of the bytes come last, so that one of them takes no other's place
    sizes = texts.select("k", "y", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size"))
    running = Window.partitionBy("y").orderBy(F.col("size") > max_class_bytes // 16, F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0)  # max_per_class rows at most, without texts
    sample = texts.join(F.broadcast(sizes.withColumn("bytes", F.sum("size").over(running)).filter(F.col("bytes") <= max_class_bytes).select("k")), "k")
    own = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    stands = tuple(max(1.0, n.get(y, 0) / max(1, own.get(y, 0))) for y in (0, 1))
    lanes = min(_LANES, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = sample.select(F.coalesce("t", F.lit("")).alias("t"), "y").repartition(lanes, "t").groupBy("t").agg(F.max("y").alias("y"))
    return fit(checkpointed(once.coalesce(lanes)), weights=stands)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted and offending (sentences, as code points) of each row. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # bounded by the training sample

    def make():
        m = Model(*shared.value)

        def apply(texts: list) -> list:
            got = [m.score(t) for t in texts]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in got]
            return [[s for s, _ in got], [int(s >= threshold) for s, _ in got], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]

        return apply

    out = map_texts(documents, [key], text, make, "score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>")
    return out.select(key, held_out(key).alias("held_out"), "score", "predicted", "offending")


def keep_clean(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents without the rows that score threshold or more; all columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    at = documents.columns.index(text)

    def run(batches):
        m = Model(*shared.value)
        for b in pieces(batches):
            yield b.filter(pa.array([m.score(t)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)

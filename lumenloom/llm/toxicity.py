"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fitting takes at most `max_toxic` and `max_clean` labelled examples, by a hash of doc_id. Terms are all words of the
examples (lower-cased, without punctuation around them) and their first three to five letters, so that inflected forms meet.
None is left out. A term weighs (1 + ln tf) * idf * relevance: relevance is log2(2 + a / max(1, c)) - 0.9 for a term that a toxic
and c clean examples have (the relevance frequency of supervised term weighting). Plain TF-IDF loses the few
telling words of a text among hundreds of others; the README has figures. Terms that no example has count in a text's norm.

Scoring finds each text's `k` nearest examples exactly, with an inverted index that knows for each term the highest
weight in every block of examples. Examples are dealt to blocks by similarity, so that blocks differ: the blocks of highest
bound set a floor under the k-th cosine, and of the others only those whose bound reaches it are scored. Neighbours vote with weight
1 / (0.05 + distance); votes are calibrated to probabilities by isotonic regression on the examples' own votes, weighted to
the label shares of all training rows. An example of the very same text never votes, neither in fitting nor in
scoring: no training document is scored by its own label. A text without any neighbour gets the toxic share of examples without one.

Defined results: null and empty texts have no terms. No toxic or no clean training label: every score is the
share of toxic labels (0 without labels). Repeated labels of a doc_id count once, as toxic if any
says so; null labels are left out. Of documents that share a labelled doc_id the one of the least text hash is the
example. Rows with equal doc_id get scores of their own, rows of equal text equal scores. The whole text counts,
however long. Extra columns are ignored by `score`; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import io
import itertools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of the model in a row on its way to the driver: below what the JVM's collector treats as huge.
PIECE = 1 << 18

_AROUND = ".,;:!?|\"'()[]{}<>*#-_…«»“”„¡¿&$%"


@dataclass(frozen=True)
class Toxicity:
    max_toxic: int = 1200
    max_clean: int = 2400
    k: int = 32
    threshold: float = 0.7
    block: int = 64
    first: int = 8  # blocks scored to find the floor
    wide: float = 0.04  # terms of more than this share of the examples are stored as columns of whole blocks
    evidence: int = 5  # neighbours reported with a score


def terms_of(word: str) -> tuple[str, ...]:
    """A word's terms: itself and its beginnings, marked apart."""
    word = word.lower().strip(_AROUND)
    return ("=" + word, *("^" + word[:n] for n in (3, 4, 5) if len(word) > n)) if word else ()


class Terms:
    """The distinct terms of texts as 64-bit hashes; what words have been met is forgotten at `limit` of them."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.first, self.hashes = np.zeros(4096, np.int64), np.zeros(16384, np.uint64)  # a word's first term; its number's next is its end

    def learn(self, words: list[str]) -> None:
        found = [[xxhash.xxh3_64_intdigest(t) for t in terms_of(w)] for w in words]
        at, n = len(self.numbers), sum(map(len, found))
        start = int(self.first[at])
        while at + len(words) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while start + n > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.numbers.update(zip(words, range(at, at + len(words))))
        self.first[at + 1 : at + len(words) + 1] = start + np.cumsum([len(x) for x in found])
        self.hashes[start : start + n] = np.fromiter(itertools.chain.from_iterable(found), np.uint64, n)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of a text, ascending, and how often each comes."""
        counts = Counter(text.split()) if text else {}
        if not counts:
            return np.empty(0, np.uint64), np.empty(0)
        new = [w for w in counts if w not in self.numbers]
        if new:
            if len(self.numbers) + len(new) > self.limit:
                self.forget()
                new = list(counts)
            self.learn(new)
        words = np.fromiter(map(self.numbers.__getitem__, counts), np.int64, len(counts))
        n = self.first[words + 1] - self.first[words]
        terms, place = np.unique(self.hashes[spans(self.first[words], n)], return_inverse=True)
        return terms, np.bincount(place, np.repeat(np.fromiter(counts.values(), float, len(counts)), n), len(terms))


def text_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length) in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by the examples' number."""

    how: Toxicity
    share: float = 0.0
    without: float = 0.0
    terms: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # ascending
    term_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    unknown: float = 0.0  # the weight of a term that no example has
    ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    same_text: dict = field(default_factory=dict)  # text key -> example numbers
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # example in each place of the blocks, -1 for none
    # Postings of term i: first[i] to first[i + 1]. A term of many examples is a column of whole blocks instead.
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    posting_place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    posting_weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of a term, or -1
    columns: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # place x column
    column_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # block x column
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chances: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms, and their weights in the unit vector of the whole text."""
        place = np.searchsorted(self.terms, terms)
        known = place < len(self.terms)
        known[known] = self.terms[place[known]] == terms[known]
        damped = 1 + np.log(counts)
        numbers = place[known]
        weights = damped[known] * self.term_weights[numbers]
        norm = np.sqrt((weights * weights).sum() + ((damped[~known] * self.unknown) ** 2).sum())
        return numbers, weights / norm if norm else weights

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], but: list[tuple[int, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (term numbers, weights) its k nearest examples but those named (ties by number), and their cosines.
        Exact: the blocks of highest bound set a floor under the k-th cosine; every block whose bound reaches it is
        then scored, the others can't hold a nearer one."""
        k, size, n = self.how.k, self.how.block, len(queries)
        blocks = len(self.number) // size
        wide, rare = np.zeros((n, self.columns.shape[1]), np.float32), np.zeros((n, len(self.number)), np.float32)
        for q, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            dense = column >= 0
            wide[q, column[dense]] = weights[dense]
            terms, weights = terms[~dense], weights[~dense]
            lengths = self.first[terms + 1] - self.first[terms]
            found = spans(self.first[terms], lengths)
            rare[q] = np.bincount(self.posting_place[found], np.repeat(weights, lengths) * self.posting_weight[found], len(self.number))
        bound = wide @ self.column_max.T + rare.reshape(n, blocks, size).max(axis=2)
        scores = np.zeros_like(rare)
        skipped = [np.flatnonzero(np.isin(self.number, b)) if b else () for b in but]

        def evaluate(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)).tolist():
                rows, at = np.flatnonzero(chosen[:, b]), slice(b * size, (b + 1) * size)
                scores[rows, at] = wide[rows] @ self.columns[at].T + rare[rows, at]
            for q, places in enumerate(skipped):
                scores[q, places] = 0

        done = np.zeros((n, blocks), bool)
        if blocks > self.how.first:
            np.put_along_axis(done, np.argpartition(-bound, self.how.first, axis=1)[:, : self.how.first], True, axis=1)
            evaluate(done)
        floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(n)
        evaluate(~done & (bound >= floor[:, None] - 1e-5) & (bound > 0))
        out = []
        for row in scores:
            hit = np.flatnonzero(row > max(1e-9, np.partition(row, -k)[-k] - 1e-5 if len(row) > k else 0))
            best = hit[np.lexsort((self.number[hit], -np.round(row[hit].astype(float), 6)))[:k]]
            out.append((self.number[best], row[best].astype(float)))
        return out

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cosines, 1))
        return float(((w * self.toxic[numbers]).sum() + self.share) / (w.sum() + 1))

    def chance(self, vote: float) -> float:
        """Calibrated; a little of the vote itself tells apart what the steps don't."""
        if not len(self.votes):
            return min(max(vote, 0.0), 1.0)
        return float(0.98 * np.interp(vote, self.votes, self.chances) + 0.02 * vote)

    def score(self, texts: list[str | None], memo: Terms) -> list[tuple[float, list[tuple]]]:
        out: list[tuple[float, list[tuple]]] = [(self.without, [])] * len(texts)
        if not len(self.ids):
            return out
        for start in range(0, len(texts), 64):
            found = [(i, memo.of(texts[i])) for i in range(start, min(start + 64, len(texts)))]
            found = [(i, f) for i, f in found if len(f[0])]
            near = self.nearest([self.vector(*f) for _, f in found], [self.same_text.get(text_key(texts[i]), ()) for i, _ in found]) if found else []
            for (i, _), (numbers, cosines) in zip(found, near):
                if len(numbers):
                    evidence = [(self.ids[n], float(s), int(self.toxic[n])) for n, s in zip(numbers[: self.how.evidence].tolist(), cosines)]
                    out[i] = self.chance(self.vote(numbers, cosines)), evidence
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (mid votes, chances) of the weighted isotonic regression of y on x, smoothed by one toxic
    and one clean row per step."""
    steps: list[list[float]] = []  # weight, weighted y, lowest x, highest x
    for i in np.argsort(x, kind="stable"):
        steps.append([w[i], w[i] * y[i], x[i], x[i]])
        while len(steps) > 1 and (steps[-2][1] / steps[-2][0] >= steps[-1][1] / steps[-1][0] or steps[-2][3] == steps[-1][2]):
            b = steps.pop()
            steps[-1] = [steps[-1][0] + b[0], steps[-1][1] + b[1], steps[-1][2], b[3]]
    xs = [v for s in steps for v in (s[2], s[3])]
    ys = [(s[1] + 0.5) / (s[0] + 1) for s in steps for _ in (0, 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def by_similarity(points: np.ndarray, block: int) -> np.ndarray:
    """An order in which neighbours are alike: halves along the direction of most variance, down to blocks."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        x = points[rows] - points[rows].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        rows = rows[np.lexsort((rows, along))]
        half = -(-len(rows) // (2 * block)) * block
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def index(model: Model, rows: list[tuple]) -> None:
    """Terms, their weights and their postings. What it takes on the way is kept to a few numbers of an entry (a term of an example), as other workers' memory lies beside it."""
    how, toxic, n = model.how, model.toxic, len(rows)
    model.terms = np.unique(np.concatenate([r[3] for r in rows]))
    term = np.concatenate([np.searchsorted(model.terms, r[3]).astype(np.int32) for r in rows])
    example = np.repeat(np.arange(n, dtype=np.int32), [len(r[3]) for r in rows])
    df, a = np.bincount(term, minlength=len(model.terms)), np.bincount(term, toxic[example], len(model.terms))
    relevance = lambda a, c: np.log2(2 + a / np.maximum(1, c)) - 0.9
    model.term_weights = (np.log((n + 1) / (df + 1)) + 1) * relevance(a, df - a)
    model.unknown = float((np.log(n + 1) + 1) * relevance(0, 0))
    w = np.log(np.concatenate([r[4] for r in rows]))
    w += 1
    w *= model.term_weights[term]
    norms = np.sqrt(np.bincount(example, w * w, n))
    w /= np.maximum(norms, 1e-300)[example]
    # A term's sign pattern over 48 directions: enough to tell which examples are alike. Drawn by pieces, as drawing takes 16 bytes a sign.
    draw, ends = np.random.RandomState(5), range(0, len(model.terms), 4096)
    signs = np.concatenate([draw.choice(np.array([-1, 1], np.int8), (min(4096, len(model.terms) - s), 48)) for s in ends])
    points = np.stack([np.bincount(example, w * signs[term, d], n) for d in range(48)], axis=1)
    del signs
    order = by_similarity(points, how.block)
    blocks = -(-n // how.block)
    model.number = np.full(blocks * how.block, -1)
    model.number[:n] = order
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    places, w = place[example], w.astype(np.float32)
    at = np.lexsort((places, term))
    term, places, w = term[at], places[at], w[at]
    del at, example
    wide = df > how.wide * n
    model.column = np.where(wide, np.cumsum(wide) - 1, -1).astype(np.int32)
    in_column = wide[term]
    model.columns = np.zeros((len(model.number), int(wide.sum())), np.float32)
    model.columns[places[in_column], model.column[term[in_column]]] = w[in_column]
    model.column_max = model.columns.reshape(blocks, how.block, -1).max(axis=1)
    model.posting_place, model.posting_weight = places[~in_column], w[~in_column]
    model.first = np.searchsorted(term[~in_column], np.arange(len(model.terms) + 1, dtype=np.int32))


def build(how: Toxicity, rows: list[tuple], share: float, total: dict[int, int]) -> Model:
    """rows: (doc_id, toxic, text key, terms, counts) of the examples; total: label -> training rows."""
    model = Model(how, share=share, without=share)
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    toxic, n = np.array([r[1] for r in rows], np.int8), len(rows)
    if not rows or toxic.all() or not toxic.any():
        return model
    weight = {y: total[y] / int((toxic == y).sum()) for y in (0, 1)}
    model.ids, model.toxic = [r[0] for r in rows], toxic
    same: dict[bytes, list[int]] = {}
    for number, r in enumerate(rows):
        same.setdefault(r[2], []).append(number)
    model.same_text = {k: tuple(v) for k, v in same.items()}
    index(model, rows)
    votes, alone = np.full(n, np.nan), np.ones(n, bool)
    for start in range(0, n, 64):
        some = rows[start : start + 64]
        for number, near in enumerate(model.nearest([model.vector(r[3], r[4]) for r in some], [model.same_text[r[2]] for r in some]), start):
            if len(near[0]):
                votes[number], alone[number] = model.vote(*near), False
    weights = np.array([weight[int(y)] for y in toxic])
    model.without = float(((weights * toxic)[alone].sum() + share) / (weights[alone].sum() + 1))
    if not alone.all():
        model.votes, model.chances = isotonic(votes[~alone], toxic[~alone].astype(float), weights[~alone])
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, how: Toxicity = Toxicity()) -> Model:
    """train: which labels to learn from, a condition on doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").filter(F.lit(True) if train is None else train)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(sum(total.values()), 1)
    if len(total) < 2:
        return Model(how, share=share, without=share)
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = marks.filter("toxic = 1").orderBy(order, "doc_id").limit(how.max_toxic).union(marks.filter("toxic = 0").orderBy(order, "doc_id").limit(how.max_clean))
    # At most max_toxic + max_clean rows of two numbers: broadcast. One text each, so no more examples than that.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Terms()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [memo.of(t) for t in texts]
            keys = pa.array([text_key(t) for t in texts], pa.binary())
            terms, counts = pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, terms, counts], names=["doc_id", "toxic", "key", "terms", "counts"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, toxic, keys = (batch.column(i).to_pylist() for i in range(3))
            terms, counts = ([x.values.to_numpy(zero_copy_only=False) for x in batch.column(i)] for i in (3, 4))
            rows += zip(ids, toxic, map(bytes, keys), (t.view(np.uint64) for t in terms), counts)
        packed = packed_model(build(how, rows, share, total))
        for start in range(0, len(packed), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([packed[start : start + PIECE]], pa.binary())], names=["start", "piece"])

    # One task puts the bounded examples together: the driver gets the finished model, and holds neither the examples nor what building takes.
    examples = sample.mapInArrow(run, "doc_id long, toxic int, key binary, terms array<long>, counts array<int>")
    pieces = examples.repartition(1).mapInArrow(built, "start long, piece binary").collect()
    return unpacked_model(b"".join(r["piece"] for r in sorted(pieces, key=lambda r: r["start"])))


def packed_model(model: Model) -> memoryview:
    """Compressed as it is pickled, without the whole pickle beside it."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as file:
        pickle.dump(model, file, pickle.HIGHEST_PROTOCOL)
    return out.getbuffer()


def unpacked_model(packed: bytes) -> Model:
    with gzip.GzipFile(fileobj=io.BytesIO(packed)) as file:
        return pickle.load(file)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence (the nearest neighbours with their cosines and labels)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by max_toxic and max_clean
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memo = shared.value, Terms()
        for batch in batches:
            found = held.score(batch.column(1).to_pylist(), memo)
            scores = [s for s, _ in found]
            evidence = pa.array([[{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in e] for _, e in found], kind)
            predicted = pa.array([int(s >= held.how.threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), predicted, evidence], names=["doc_id", "score", "predicted", "evidence"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that fitting may not learn from: crc32 of doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, whose score is under the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memo = shared.value, Terms()
        for batch in batches:
            keep = [s < held.how.threshold for s, _ in held.score(batch.column(at).to_pylist(), memo)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

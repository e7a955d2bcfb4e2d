"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = sigmoid(w.x - threshold_k): one weight vector is shared, the thresholds are ordered. x holds what a text
is made of, hashed: its distinct words, the shapes of its words, and coarse steps of its shares of capitals, signs and
repetition. Words are counted over whole texts.

The model is fitted on the driver on a sample of labelled documents, those of the least hashes, bounded by two parameters:
max_rows documents and max_entries entries of x in all. Everything else is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

DIM = 1 << 18
MAX_ROWS = 6000
MAX_ENTRIES = 20_000_000
CACHED = 100_000
CORE = re.compile(r"^\W*(.*?)\W*$", re.S)
_places: dict[str, int] = {}


def place(feature: str) -> int:
    if (i := _places.get(feature)) is None:
        if len(_places) >= CACHED:
            _places.clear()
        i = _places[feature] = zlib.crc32(feature.encode()) % DIM
    return i


def shape(word: str) -> str:
    """Case of the letters and the signs behind them: 'THE!!' is U!!, 'the' l, 'Thnd***' T***."""
    core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "d" if core.isdigit() else "x"
    return case + word[len(core) :][:4]


def step(share: float) -> int:
    return min(int(share * 10), 10)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and values of x; none for a null or wordless text."""
    counts = Counter((text or "").split())
    n = sum(counts.values())
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    x: Counter[int] = Counter()
    shapes: Counter[str] = Counter()
    for w, c in counts.items():
        shapes[shape(w)] += c
        x[place("w:" + w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"))] += 0.5
    for s, c in shapes.items():
        x[place("s:" + s)] += 2 * (c / n) ** 0.5
    lines = [s for s in text.split("\n") if s]
    signs = sum(c for s, c in shapes.items() if len(s) > 2)
    capitals = sum(c for s, c in shapes.items() if s[0] == "U")
    top = counts.most_common(1)[0][1]
    for name, share in (("distinct", len(counts) / n), ("lines", len(set(lines)) / max(len(lines), 1)), ("signs", signs / n), ("capitals", capitals / n), ("top", top / n)):
        x[place(f"{name}:{step(share)}")] += 1
        x[place(f"{name}:share")] += 2 * share
    x[place(f"short:{min(n, 1 << 12).bit_length()}")] += 0.5
    at = np.array(sorted(x), np.int32)
    return at, np.array([x[i] for i in at.tolist()], np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one for each grade but the least
    grades: list[int]

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for each grade but the least."""
        at, x = features(text)
        z = float(self.weights[at] @ x) if len(at) else 0.0
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 250, decay: float = 2e-4, rate: float = 0.05) -> Model:
    """Maximum likelihood by Adam over the whole sample; thresholds stay ordered as a first one and positive gaps."""
    kinds = sorted(set(grades.tolist()))
    w, cut = np.zeros(DIM), np.zeros(max(len(kinds) - 1, 0))
    if len(kinds) < 2:
        return Model(w, cut - 40, kinds)  # one grade: everything has it
    y = np.searchsorted(kinds, grades)
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([v for _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    share = np.bincount(y, minlength=len(kinds)) / len(y)
    upper = 1 - np.cumsum(share)[:-1]
    cut = -np.log(upper / (1 - upper))
    free = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 1e-3))])
    # classes weigh alike, as far as a factor of ten
    scale = np.clip(1 / (share * len(kinds)), 0.1, 10)[y]
    scale /= scale.sum()
    params = np.concatenate([w, free])
    first, second = np.zeros_like(params), np.zeros_like(params)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for t in range(1, rounds + 1):
        gaps = np.exp(params[DIM + 1 :])
        cut = params[DIM] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, x * params[at], len(rows))
        tail = sig(z[:, None] - cut)
        edge = np.concatenate([np.ones((len(z), 1)), tail, np.zeros((len(z), 1))], axis=1)
        slope = edge * (1 - edge)
        i = np.arange(len(z))
        p = np.maximum(edge[i, y] - edge[i, y + 1], 1e-12)
        by_z = -scale * (slope[i, y] - slope[i, y + 1]) / p
        by_cut = np.zeros((len(z), len(cut) + 2))
        by_cut[i, y] += scale * slope[i, y] / p
        by_cut[i, y + 1] -= scale * slope[i, y + 1] / p
        by_cut = by_cut[:, 1:-1].sum(axis=0)
        tails_of = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, x * by_z[row], DIM) + decay * params[:DIM], [tails_of[0]], tails_of[1:] * gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cut = params[DIM] + np.concatenate([[0.0], np.cumsum(np.exp(params[DIM + 1 :]))])
    return Model(params[:DIM], cut, kinds)


def grade(quality: Column, toxic: Column) -> Column:
    """0: bad quality; 1: good but toxic; 2: good. Null quality: no rating; null toxic: not toxic."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) != 0, 1).when(quality.isNotNull(), 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES) -> Model:
    """labels: doc_id, quality, toxic. Of rated documents those of the least hashes are learned from: max_rows of them at
    most, and as many as have max_entries entries of x together.

    A document rated twice counts twice, one that stands repeatedly in docs once; ratings without a document, and nulls,
    don't count, nor do texts without a word.
    """
    rated = labels.select(F.col("doc_id").alias("_doc"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("_doc is not null and grade is not null")
    rated = rated.orderBy(F.xxhash64("_doc"), "_doc", "grade").limit(max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("_doc")).select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t.as_py()) for t in b.column(2)]
            packed = [pa.array([x[k].tobytes() for x in xs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed], names=["doc_id", "grade", "at", "x"])

    found = mapped(chosen, run, "doc_id long, grade int, at binary, x binary").where("length(at) > 0")
    found = found.withColumn("h", F.xxhash64("doc_id", "at", "x")).withColumn("entries", F.length("at") / 4)
    # a document that stands often is one row for each of its ratings; repeated ratings come back from rated's own count
    found = written(found.groupBy("h", "doc_id", "grade").agg(F.first("at").alias("at"), F.first("x").alias("x"), F.first("entries").alias("entries")), "features")
    sizes = found.join(F.broadcast(rated.groupBy("_doc", F.col("grade").alias("g")).agg(F.count("*").alias("times"))), (F.col("doc_id") == F.col("_doc")) & (F.col("grade") == F.col("g")))
    sizes = sizes.select("h", "grade", "times", "entries").orderBy("h", "grade").limit(max_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["entries"]
        if total > max_entries and last is not None:
            break
        last = r["h"]
    got = {(r["h"], r["grade"]): r for r in found.where(F.col("h") <= F.lit(last)).select("h", "grade", "at", "x").collect()} if sizes else {}
    rows = [got[r["h"], r["grade"]] for r in sizes if r["h"] <= last for _ in range(r["times"])]
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in rows], np.array([r["grade"] for r in rows], int))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns of keep, expected_grade, p_fair (grade 1 or better), p_good (grade 2 or better).

    Without ratings to learn from all are 1 and the expected grade is null. A null or wordless text has no features and
    gets the thresholds' own probabilities.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "expected_grade", "p_fair", "p_good"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = []
            for t in b.column(0):
                tails = m.tails(t.as_py())
                expected = round(m.grades[0] + float(np.diff(m.grades) @ tails), 6) if m.grades else None
                at = lambda g, tails=tails: round(float(next((p for k, p in zip(m.grades[1:], tails, strict=True) if k >= g), 0.0 if m.grades and m.grades[-1] < g else 1.0)), 6)
                rows.append((expected, at(1) if not m.grades or m.grades[0] < 1 else 1.0, at(2) if not m.grades or m.grades[0] < 2 else 1.0))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, pa.float64()) for c in columns)], names=names)

    docs = docs.select("text", *keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return mapped(docs, run, fields + "expected_grade double, p_fair double, p_good double")


def graded(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_fair, p_good, keep: whether p_fair reaches least.

    Repeated rows come back as often as they came; other columns aren't read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, train(docs, labels, max_rows)).withColumn("keep", F.col("p_fair") >= least)


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs' rows, all columns, whose P(grade >= 1) reaches least; with nothing learned all rows. Null and wordless texts
    are judged by the thresholds alone; repeated rows alike; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        at = next((i for i, g in enumerate(m.grades[1:]) if g >= 1), None) if m.grades and m.grades[0] < 1 else None
        for b in batches:
            yield b if at is None else b.filter(pa.array([bool(m.tails(t.as_py())[at] >= least) for t in b.column(column)], pa.bool_()))

    return mapped(docs, run, docs.schema)

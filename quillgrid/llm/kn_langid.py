"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays.

Texts become symbols of 12 bits: letters, lower-cased, and one symbol for every run of anything else. An n-gram is its
symbols packed into a long (letters of far blocks share symbols: that is the hash). The highest order counts n-grams;
a lower one counts how many different symbols precede them. Each language interpolates its orders with absolute
discounts from its own counts of counts. All of this is tables in Spark over every n-gram and every language of the
training rows: nothing is left out, and nothing is collected but one row for each language.

For scoring, an order's n-grams of all languages are one sorted array, with a run of (language, log-probability) for
each; what a language hasn't seen backs off by its context's weight. A model of up to `send_bytes` is sent to the tasks;
a larger one stays a table that the texts' distinct n-grams are joined with, which gives the same numbers. A text goes
to the language of the lowest cross-entropy per symbol; it is rejected if that is above what nearly all texts of that
language have which a second model, fitted without them, has scored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mapped, written

BITS = 12
ORDER = 4
#: Up to this size the model is sent to every task; beyond it, scoring joins tables.
SEND_BYTES = 256 << 20
#: One in so many training texts, by hash, is kept from the second model, whose scores of them calibrate rejection.
FOLDS = 8
#: Nats above a language's mean that are always accepted; for short texts, more by this over the root of their symbols.
SLACK, SHORT_TEXT = 1.0, 4.0
SHARPNESS = 12.0
#: Names of the models of all rows, and of all but one fold's.
ALL, REST = "a", "r"
BLOCK = 1 << 19
_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """By code point: 0 for all but letters, else 1 to 4095. The first 4095 code points keep apart."""
    if not _symbols:
        letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        points = np.arange(sys.maxunicode + 1)
        _symbols.append(np.where(letter, points % 4095 + 1, 0).astype(np.uint16))
    return _symbols[0]


def symbols(text: str) -> np.ndarray:
    """A text's symbols between single boundaries (0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    s = symbol_table()[points]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s = s[keep]
    return s[1:] if len(s) and not s[0] else s


def ngrams(s: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each symbol; boundaries stand before the first."""
    padded = np.concatenate([np.zeros(order - 1, np.int64), s.astype(np.int64)])
    out = padded[order - 1 :].copy()
    for back in range(1, order):
        out |= padded[order - 1 - back : len(padded) - back] << (BITS * back)
    return out


def _counted(order: int):
    """(lang, fold, gram, n) of batches (lang, fold, text), summed in the task as far as memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, fold), grams in held.items():
                keys, n = np.unique(np.concatenate(grams), return_counts=True)
                none = pa.array(np.zeros(len(keys), np.int8))
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(none), pa.array([fold], pa.int32()).take(none), pa.array(keys), pa.array(n)], names=["lang", "fold", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if len(s := symbols(text.as_py())):
                    held.setdefault((lang, fold), []).append(ngrams(s, order))
                    waiting += len(s)
                    if waiting >= 2 * BLOCK:
                        yield from out()
                        waiting = 0
        yield from out()

    return run


def _fitted(counts: DataFrame, order: int) -> DataFrame:
    """(k, kind, gram, lang, log) of (lang, gram, n), n-grams of the highest order: kind 1 has log-probabilities of the
    n-grams of order k, kind 0 the log weights with which their contexts back off. Aggregations and equi-joins."""
    levels = [counts.select("lang", "gram", F.col("n").cast("double").alias("c"))]
    for k in range(order - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")).agg(F.count("*").cast("double").alias("c")))
    out, lower = None, None
    for k, level in enumerate(levels[::-1], 1):
        some = F.sum((F.col("c") == 1).cast("double")), F.sum((F.col("c") == 2).cast("double"))
        discount = F.coalesce(F.try_divide(some[0], some[0] + 2 * some[1]), F.lit(0.5))
        discounts = level.groupBy("lang").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.1), discount)).alias("d"))
        level = level.join(discounts, "lang").withColumn("context", F.shiftright("gram", BITS))
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.first("d").alias("d"))
        contexts = written(contexts.select("lang", "context", "total", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")), f"contexts{k}")
        level = level.join(contexts, ["lang", "context"]).withColumn("own", F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total"))
        if lower is None:
            level = level.withColumn("p", F.col("own") + F.col("weight") / (1 << BITS))
        else:
            level = level.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(lower, ["lang", "suffix"])
            level = level.withColumn("p", F.col("own") + F.col("weight") * F.col("below"))
        level = written(level.select("lang", "gram", "p"), f"order{k}")
        lower = level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        part = lambda t, kind, gram, value, k=k: t.select(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.col(gram).alias("gram"), "lang", F.log(value).cast("float").alias("log"))
        both = part(level, 1, "gram", "p").union(part(contexts, 0, "context", "weight"))
        out = both if out is None else out.union(both)
    return out


class Arrays:
    """Sorted n-grams; for each a run of languages with a value."""

    def __init__(self, grams: np.ndarray, langs: np.ndarray, values: np.ndarray):
        at = np.lexsort((langs, grams))
        self.langs, self.values = langs[at].astype(np.int32), values[at].astype(np.float32)
        self.grams, starts = np.unique(grams[at], return_index=True)
        self.ends = np.append(starts, len(at)).astype(np.int64)

    def put(self, grams: np.ndarray, into: np.ndarray, add: bool) -> None:
        """Sets, or adds, what the languages have for grams in the rows of into."""
        if not len(self.grams):
            return
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        row = np.flatnonzero(self.grams[at] == grams)
        n = self.ends[at[row] + 1] - self.ends[at[row]]
        rows = np.repeat(row, n)
        i = np.repeat(self.ends[at[row]] - np.cumsum(n) + n, n) + np.arange(len(rows))
        if add:
            into[rows, self.langs[i]] += self.values[i]
        else:
            into[rows, self.langs[i]] = self.values[i]


@dataclass
class Model:
    """langs; table: what _fitted gives with langs' places, or arrays: (k, kind) -> Arrays where it is small enough to
    send. worst: the cross-entropy above which a language's text is rejected."""

    langs: list[str]
    order: int
    worst: np.ndarray
    arrays: dict[tuple[int, int], Arrays] | None = None
    table: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities, in each language, of each n-gram's last symbol after the others."""
        out = np.full((len(grams), len(self.langs)), -BITS * np.log(2), np.float32)
        for k in range(1, self.order + 1):
            part = grams & ((1 << BITS * k) - 1)
            self.arrays[k, 0].put(part >> BITS, out, add=True)
            self.arrays[k, 1].put(part, out, add=False)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text in each language; symbols by text (0 if it has no letter)."""
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        block, held = max(1 << 12, BLOCK // max(len(self.langs), 1)), 0
        part: list[tuple[int, np.ndarray]] = []

        def score() -> None:
            lengths = np.array([len(g) for _, g in part])
            kinds, which = np.unique(np.concatenate([g for _, g in part]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            np.add.at(sums, [i for i, _ in part], np.add.reduceat(self.logs(kinds)[which], starts, axis=0, dtype=np.float64))
            part.clear()

        for i, text in enumerate(texts):
            s = symbols(text or "")
            if not len(s):
                continue
            n[i] = len(s)
            grams = ngrams(s, self.order)
            for at in range(0, len(grams), block):
                part.append((i, grams[at : at + block]))
                held += len(part[-1][1])
                if held >= block:
                    score()
                    held = 0
        if part:
            score()
        return -sums / np.maximum(n, 1)[:, None], n


def _model(table: DataFrame, langs: list[str], which: str, order: int, send_bytes: int) -> Model:
    """Of what _fitted gives for languages named `which` and a language: the model of langs."""
    places = table.sparkSession.createDataFrame([(i, which + x) for i, x in enumerate(langs)], "at int, lang string")
    own = table.join(places, "lang").drop("lang")
    model = Model(langs, order, np.full(len(langs), np.inf))
    if 16 * own.count() > send_bytes:
        model.table = written(own, "model")
        return model
    got = own.toArrow()
    k, kind, gram, value, at = (got.column(c).to_numpy() for c in ("k", "kind", "gram", "log", "at"))
    model.arrays = {(i, j): Arrays(gram[(k == i) & (kind == j)], at[(k == i) & (kind == j)], value[(k == i) & (kind == j)]) for i in range(1, order + 1) for j in (0, 1)}
    return model


def _lists(rows: np.ndarray) -> pa.Array:
    """An array of lists: the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _measured(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns of docs, n (symbols of text) and h: cross-entropies by model.langs. One pass without a shuffle if
    the model is small enough to send."""
    others = [c for c in keep if c != "text"]
    if model.arrays is None:
        return _measured_by_join(docs, model, others).select(*keep, "n", "h")
    own = ["text"] if "text" in keep else []
    schema = StructType([*docs.select(*others, *own).schema.fields, *StructType.fromDDL("n long, h array<double>").fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                h, n = sent.value.cross_entropies(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *part.columns[: len(own)], pa.array(n, pa.int64()), _lists(h)], names=[*others, *own, "n", "h"])

    return mapped(docs.select("text", *others), run, schema).select(*keep, "n", "h")


def _measured_by_join(docs: DataFrame, model: Model, others: list[str]) -> DataFrame:
    """The same for a model that is too large to send: the distinct n-grams of docs are joined with the model's tables."""
    order, langs = model.order, len(model.langs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = symbols(text.as_py() or "")
                if len(s):
                    grams, n = np.unique(ngrams(s, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row)), pa.array(grams), pa.array(n)], names=["row", "gram", "n"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full((b.num_rows, langs), -BITS * np.log(2), np.float32)
            for c in range(1, b.num_columns):
                some = b.column(c)
                rows = np.repeat(np.arange(b.num_rows), np.array([len(x) if x.is_valid else 0 for x in some], np.int64))
                flat = some.flatten()
                at, value = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                if c % 2:  # weights of contexts, then probabilities, from order 1 up
                    out[rows, at] += value
                else:
                    out[rows, at] = value
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], names=["gram", "logs"])

    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "text", *others), "rows")
    grams = written(mapped(rows.select("row", "text"), cut, "row long, gram long, n long"), "text_ngrams")
    known = grams.select("gram").distinct()
    for k in range(1, order + 1):
        for kind in (0, 1):
            part = model.table.where((F.col("k") == k) & (F.col("kind") == kind)).groupBy(F.col("gram").alias("_g")).agg(F.collect_list(F.struct("at", "log")).alias(f"v{k}{kind}"))
            gram = F.col("gram").bitwiseAND((1 << BITS * k) - 1)
            known = known.join(part, (gram if kind else F.shiftright(gram, BITS)) == F.col("_g"), "left").drop("_g")
    logs = mapped(known, dense, "gram long, logs array<float>")
    each = [F.sum(F.col("n") * F.get("logs", F.lit(i))).alias(f"s{i}") for i in range(langs)]
    sums = grams.join(logs, "gram").groupBy("row").agg(F.sum("n").alias("n"), *each)
    sums = sums.select("row", "n", F.array(*[-F.col(f"s{i}") / F.col("n") for i in range(langs)]).alias("h"))
    out = rows.join(sums, "row", "left")
    return out.select("text", *others, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("h", F.array_repeat(F.lit(0.0), langs)).alias("h"))


def train(docs: DataFrame, training: Column, order: int = ORDER, send_bytes: int = SEND_BYTES) -> Model:
    """A model of docs' rows with text and lang for which training holds: every language, every n-gram.

    Rejection: each language's worst cross-entropy is the mean of its distinct texts in one fold of FOLDS, as a model
    fitted on the other folds scores them, plus six standard deviations (SLACK nats at least). A language without a text
    there has the largest of the others' (without any, all is accepted).
    """
    fold = (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) != 0).cast("int")
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", fold.alias("fold"), "text")
    grams = mapped(rows, _counted(order), "lang string, fold int, gram long, n long")
    rest = F.sum(F.col("n") * F.col("fold"))
    grams = written(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"), rest.alias("rest")), "ngrams")
    seen = {r["lang"]: r["rest"] for r in grams.groupBy("lang").agg(F.max("rest").alias("rest")).collect()}
    if not seen:
        return Model([], order, np.zeros(0))
    # both models are fitted at once, each language twice: of all rows, and of those but the fold's
    every = grams.select(F.concat(F.lit(ALL), "lang").alias("lang"), "gram", "n").union(grams.where("rest > 0").select(F.concat(F.lit(REST), "lang"), "gram", "rest"))
    table = written(_fitted(every, order), "fitted")
    model = _model(table, sorted(seen), ALL, order, send_bytes)
    learned_without = sorted(x for x, rest in seen.items() if rest)
    if learned_without:
        calibrate(model, _model(table, learned_without, REST, order, send_bytes), rows.where("fold = 0"))
    return model


def calibrate(model: Model, other: Model, rows: DataFrame) -> None:
    """Sets model.worst from rows (lang, text), which other hasn't seen."""
    own = F.create_map(*[F.lit(x) for i, lang in enumerate(other.langs) for x in (lang, i)])
    rows = rows.select("text", "lang", F.xxhash64("text").alias("copy")).where(F.try_element_at(own, F.col("lang")).isNotNull())
    scored = _measured(rows, other, ("lang", "copy")).where("n > 0").select("lang", "copy", F.get("h", F.try_element_at(own, F.col("lang"))).alias("h"))
    stats = scored.groupBy("lang", "copy").agg(F.first("h").alias("h")).groupBy("lang").agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("sd")).collect()
    worst = {r["lang"]: r["mean"] + max(6 * r["sd"], SLACK) for r in stats}
    model.worst = np.array([worst.get(lang, max(worst.values(), default=np.inf)) for lang in model.langs])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 modulo 3 (no doc_id: false, and not learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _judged(measured: DataFrame, model: Model) -> DataFrame:
    """measured and lang_pred, score, cross_entropy, accepted, from n and h."""
    lowest, some = F.array_min("h"), F.col("n") > 0
    langs, worst = F.array(*[F.lit(x) for x in model.langs]), F.array(*[F.lit(float(x)) for x in model.worst])
    out = measured.withColumn("cross_entropy", F.when(some, lowest).otherwise(0.0)).withColumn("_at", F.when(some, F.array_position("h", lowest).cast("int") - 1))
    shares = F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(-SHARPNESS * (x - lowest)))
    accepted = F.col("cross_entropy") <= F.get(worst, F.col("_at")) + SHORT_TEXT / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double"))
    out = out.withColumn("lang_pred", F.coalesce(F.get(langs, F.col("_at")), F.lit("und"))).withColumn("score", F.when(some, 1 / shares).otherwise(0.0))
    return out.withColumn("accepted", F.coalesce(some & accepted, F.lit(False))).drop("_at", "n", "h")


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns of keep, lang_pred, score (0 to 1, of the language among the learned), cross_entropy, accepted.

    Null texts and texts without a letter are und with score 0, not accepted; so is every text if nothing was learned.
    Of languages that score alike the first by name is taken.
    """
    if not model.langs:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("accepted"))
    return _judged(_measured(docs, model, keep), model)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learns from the rows that aren't held out and predicts for all: doc_id, held_out, lang_pred, score, and more.

    lang, source and doc_id are no inputs of a prediction. Rows without a doc_id are predicted and not learned from.
    An empty table gives no rows; repeated rows come back as often as they came.
    """
    model = train(docs.select("text", "lang", "doc_id"), learned(F.col("doc_id")), **options)
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows, all columns, whose language is accepted; with nothing learned all rows. Null texts and texts without
    a letter go; repeated rows are judged alike; an empty table gives no rows."""
    if not model.langs:
        return docs
    mine = {c: c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = predict(docs.select(*[F.col(f"`{c}`").alias(m) for c, m in mine.items()]), model, tuple(mine.values()))
    return judged.where("accepted").select(*[F.col(m).alias(c) for c, m in mine.items()])

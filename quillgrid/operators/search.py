"""A page's text for searching: the layout engine's blocks with the text engine's words, what that engine found beside
them, without duplicates, in reading order. Each step depends on those before, so a page is one row of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import alike, distinct, token_set_ratio
from ..functions.likeness import LEAST, Likeness, near
from ..functions.likeness import overlap as overlaps
from ..sources.pages import PAGE_HEIGHT, PAGE_WIDTH
from .blocks import READING_ORDER, classify, looked_up, page_types

#: Regions by block type; types without one are one region.
REGIONS = {
    "masthead_logo": "masthead", "newspaper_name": "masthead", "issue_meta": "masthead", "main_headline": "headline", "secondary_headline": "headline", "bottom_headline": "headline", "right_sidebar": "right_sidebar",
    "bottom_columns": "bottom_columns", "image_caption": "caption", "body_text": "body", "continuation_box": "continuation", "footer_bar": "footer",
}
#: Weights of overlap and likeness, what makes a block eligible, what another block may overlap, its least
#: length, and the confidence of words taken over.
OVERLAP, LIKENESS, LEAST_OVERLAP, LEAST_LIKENESS, FREE, CHARS, TAKEN_OVER = 0.55, 0.45, 0.08, 0.75, 0.12, 4, 0.9


def overlap(a: dict, b: dict) -> float:
    """Common area by joint area of plain boxes."""
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: max(0.0, r["x2"] - r["x1"]) * max(0.0, r["y2"] - r["y1"])
    joint = area(a) + area(b) - w * h
    return w * h / joint if joint > 0 else 0.0


def enriched(block: dict, others: list[dict]) -> dict:
    """The block with the best other's text: by overlap and by likeness to the best text so far, so the order of others
    counts. Others that can't win aren't compared."""
    text, norm, best = block["text"], block["norm"], 0.0
    for o in others:
        common = overlap(block, o)
        if OVERLAP * common + LIKENESS <= best:
            continue
        like = token_set_ratio(norm, o["norm"]) / 100
        score = OVERLAP * common + LIKENESS * like
        if score > best and (common >= LEAST_OVERLAP or like >= LEAST_LIKENESS):
            best, text, norm = score, o["text"], o["norm"]
    if text == block["text"]:
        return block
    # its worth as a duplicate is that of the new words
    found = next(o for o in others if o["text"] == text)
    sure = max(block["confidence"], TAKEN_OVER)
    return block | {"text": text, "norm": norm, "words": found.get("words"), "engine": "text_engine", "confidence": sure, "quality": found["worth"] + 20 * sure + 15}


def supplemented(blocks: list[dict], others: list[dict]) -> list[dict]:
    """Others of some length that overlap none of the blocks, nor of those added before, and aren't like one of them."""
    out = list(blocks)
    for o in others:
        if len(o["text"]) < CHARS or any(overlap(o, b) >= FREE for b in out) or any(alike(o, b) is not None for b in out):
            continue
        out.append(o)
    return out[len(blocks) :]


#: Kinds of rows, in the order in which a page has them: its type, the layout engine's blocks, the text engine's. What a
#: block has, in the order in which blocks are sorted.
TYPE, OWN, OTHER = 0, 1, 2
FIELDS = ("pos", "text", "norm", "engine", "confidence", "region", "block_type", "worth", "quality", "x1", "y1", "x2", "y2")


def _rows(blocks: DataFrame, engine: str, kind: int, first: int) -> DataFrame:
    """(page, kind, FIELDS): blocks with all that the steps need; texts are stripped and mended."""
    bonus = 15.0 if engine == "text_engine" else 0.0
    # each text is mended, judged and normalised once: what follows reads columns. Blocks without text are left out after
    # that, as a filter here would mend each again
    text = T.strip(T.repair_mojibake(F.coalesce("text", F.lit(""))))
    rows = blocks.where("x1 is not null").select("page", (F.col("pos") + first).cast("int").alias("pos"), text.alias("text"), F.col("confidence").cast("double").alias("confidence"), "block_type", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    rows = rows.withColumn("worth", (F.length("text") - F.when(T.is_noise(F.col("text")), 25.0).otherwise(0.0)).cast("double")).withColumn("norm", T.normalized_for_match(F.col("text")))
    rows = rows.withColumns({"engine": F.lit(engine), "region": looked_up(REGIONS, F.col("block_type"), ""), "quality": F.col("worth") + 20 * F.col("confidence") + bonus})
    return rows.select("page", F.lit(kind).alias("kind"), *FIELDS)


def layer(blocks: DataFrame, others: DataFrame | None = None, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, kept, removed, n_before, document_type): kept: array of blocks (pos, text, engine, block_type, confidence,
    x1..y2) in order; removed: (kept_pos, pos, similarity, kept_preview, preview); document_type: as page_types has it.

    blocks: classified (page, pos, text, block_type, render_mode, confidence, x1..y2); photos don't take part. others: the
    text engine's (page, pos, label, text, x1..y2); their pos come out as 10,000 more.

    Blocks go to Python as rows sorted by page, in batches of as many blocks, however large the task: a worker holds a batch
    and what it has of the page that isn't complete.
    """
    rows = _rows(blocks.where("render_mode <> 'image'"), "layout_engine", OWN, 0)
    if others is not None:
        rows = rows.unionByName(_rows(classify(others, w=w, h=h).withColumn("confidence", F.lit(0.85)), "text_engine", OTHER, 10_000))
    types = page_types(blocks, w, h).select("page", F.lit(TYPE).alias("kind"), F.col("document_type").alias("block_type"))
    rows = rows.unionByName(types, allowMissingColumns=True).repartition("page").sortWithinPartitions("page", "kind", *FIELDS)
    item = "pos:int,text:string,engine:string,block_type:string,confidence:double,x1:double,y1:double,x2:double,y2:double"
    schema = f"page long, kept array<struct<{item}>>, removed array<struct<kept_pos:int,pos:int,similarity:double,kept_preview:string,preview:string>>, n_before int, document_type string"
    names = [x.split(":")[0] for x in item.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_pages(batches):
            page, types, *both = _sides(b)
            rows = _Rows(*both)
            pages = [rows.merged(*p) if p[1] - p[0] + p[3] - p[2] <= MATRIX else rows.merged_plainly(*p) for p in rows.pages]
            kept, gone, starts = [x for p in pages for x in p[0]], [x for p in pages for x in p[1]], lambda i: np.cumsum([0, *(len(p[i]) for p in pages)])
            yield pa.RecordBatch.from_arrays([page, _lists(starts(0), rows.kept(kept, names)), _lists(starts(1), rows.removed(gone)), pa.array([p[2] for p in pages], pa.int32()), types], names=["page", "kept", "removed", "n_before", "document_type"])

    return rows.withColumn("page", F.col("page").cast("long")).mapInArrow(run, schema)


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (page, kind, ..), sorted, in batches that end where a page does. Rows of no page are one of each kind."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        # blocks without text, which no step reads
        b = b.filter(pc.or_(pc.equal(b["kind"], TYPE), pc.not_equal(pc.fill_null(b["text"], ""), "")))
        if not b.num_rows:
            continue
        cut = int(_firsts(b)[-1])
        if cut or held and _key(held[-1], -1) != _key(b, 0):
            if held or cut:
                yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _key(b: pa.RecordBatch, i: int) -> tuple:
    page = b["page"][i].as_py()
    return page, b["kind"][i].as_py() if page is None else None


def _firsts(b: pa.RecordBatch) -> np.ndarray:
    """Where each page's rows begin."""
    page, none, kind = pc.fill_null(b["page"], 0).to_numpy(), b["page"].is_null().to_numpy(zero_copy_only=False), b["kind"].to_numpy()
    new = (page[1:] != page[:-1]) | (none[1:] != none[:-1]) | (none[1:] & (kind[1:] != kind[:-1]))
    return np.flatnonzero(np.concatenate([[True], new]))


def _sides(b: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.ListArray, pa.ListArray]:
    """Pages that have blocks, their types, and the blocks of either engine as an array for each page."""
    kind, firsts = b["kind"].to_numpy(), _firsts(b)
    blocks = np.add.reduceat(kind != TYPE, firsts, dtype=np.int64)
    rows = pa.StructArray.from_arrays([b[c] for c in FIELDS], list(FIELDS))
    lists = []
    for k in (OWN, OTHER):
        many = np.add.reduceat(kind == k, firsts, dtype=np.int64)[blocks > 0]
        lists.append(_lists(np.cumsum([0, *many]), rows.take(pa.array(np.flatnonzero(kind == k)))))
    firsts = firsts[blocks > 0]
    types = pa.array([t if k == TYPE and p is not None else None for t, k, p in zip(*(b[c].take(pa.array(firsts)).to_pylist() for c in ("block_type", "kind", "page")), strict=True)], pa.string())
    return b["page"].take(pa.array(firsts)), types, *lists


def _lists(starts: np.ndarray, rows: pa.StructArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows)


#: Blocks of a page up to which all of them are compared at once; pages of more are gone through block by block.
MATRIX = 1024
_known: list[Likeness] = []


class _Rows:
    """All blocks of a batch of pages, the layout engine's before the text engine's, as arrays. A block that stays is
    (where it is, where its words are, its confidence)."""

    def __init__(self, mine: pa.ListArray, theirs: pa.ListArray):
        self.rows = pa.concat_arrays([mine.flatten(), theirs.flatten().cast(mine.type.value_type)])
        a, b = (np.cumsum([0, *(x or 0 for x in pc.list_value_length(c).to_pylist())]) for c in (mine, theirs))
        self.pages = list(zip(a[:-1].tolist(), a[1:].tolist(), (b[:-1] + a[-1]).tolist(), (b[1:] + a[-1]).tolist(), strict=True))
        numbers = lambda c: self.rows.field(c).to_numpy(zero_copy_only=False)
        self.box, self.pos = [numbers(c) for c in ("x1", "y1", "x2", "y2")], numbers("pos")
        self.confidence, self.quality, self.worth = (numbers(c) for c in ("confidence", "quality", "worth"))
        self.norm, self.text = (self.rows.field(c).to_pylist() for c in ("norm", "text"))
        self.region = self.rows.field("region").dictionary_encode().indices.to_numpy()
        self.long = pc.utf8_length(self.rows.field("text")).to_numpy() >= CHARS
        if not _known:
            _known.append(Likeness())
        self.known = _known[0]

    def merged(self, a: int, b: int, c: int, d: int) -> tuple[list, list, int]:
        """What stays and goes of the page whose own blocks are a to b and whose others are c to d; and how many there were
        before duplicates went: as merged_plainly, all pairs at once."""
        at, m, known = [*range(a, b), *range(c, d)], b - a, self.known
        if not at:
            return [], [], 0
        box, ids = [x[at] for x in self.box], known.of([self.norm[i] for i in at])
        common, region = overlaps(*box), self.region[at]
        words, quality = list(at), self.quality[at]
        confidence = self.confidence[at].tolist()
        if m and m < len(at):
            self._enrich(at, m, ids, common, words, quality, confidence)
        like = known.alike(ids, ids, near(*box), region[:, None] == region[None, :])
        # others that overlap none and are like none, of the page's own and of those added
        out, bad = list(range(m)), (common >= FREE) | (like > 0)
        free = ~bad[m:, :m].any(axis=1) & self.long[at[m:]]
        for j in (m + np.flatnonzero(free)).tolist():
            if not bad[j, out[m:]].any():
                out.append(j)
        kept, removed = [], []
        for j in out:
            row = like[j, kept]
            k = int((row > 0).argmax()) if kept else 0
            if not kept or not row[k] > 0:
                kept.append(j)
                continue
            better = quality[j] > quality[kept[k]]
            removed.append((j, kept[k], float(row[k])) if better else (kept[k], j, float(row[k])))
            if better:
                kept[k] = j
        full = lambda j: (at[j], words[j], confidence[j])
        return [full(j) for j in kept], [(full(k), full(g), score) for k, g, score in removed], len(out)

    def _enrich(self, at: list[int], m: int, ids: np.ndarray, common: np.ndarray, words: list[int], quality: np.ndarray, confidence: list[float]) -> None:
        """enriched, for the page's first m blocks: puts in the numbers of their new texts, and what follows from them."""
        known, theirs = self.known, ids[m:]
        over = common[:m, m:]
        tokens, among = known.token_sets(ids[:m], theirs), known.token_sets(theirs, theirs) >= LEAST
        met = over >= LEAST_OVERLAP
        can, over, numbers = met | (tokens >= LEAST), over.tolist(), theirs.tolist()
        for i in np.flatnonzero(can.any(axis=1)).tolist():
            best, found, own, may = 0.0, -1, int(ids[i]), can[i].tolist()
            for j, area in enumerate(over[i]):
                if not may[j] or OVERLAP * area + LIKENESS <= best:
                    continue
                like = known.exact(own, numbers[j]) / 100
                score = OVERLAP * area + LIKENESS * like
                if score > best and (area >= LEAST_OVERLAP or like >= LEAST_LIKENESS):
                    best, found, own, may = score, j, numbers[j], (met[i] | among[j]).tolist()
            text = self.text[at[m + found]] if found >= 0 else self.text[at[i]]
            if text != self.text[at[i]]:
                sure = max(confidence[i], TAKEN_OVER)
                ids[i], words[i], confidence[i] = own, at[m + found], sure
                quality[i] = self.worth[at[m + found]] + 20 * sure + 15

    def merged_plainly(self, a: int, b: int, c: int, d: int) -> tuple[list, list, int]:
        """merged, block by block."""
        rows = lambda i, j: [r | {"at": i + k, "words": i + k} for k, r in enumerate(self.rows[i:j].to_pylist())]
        mine, theirs = rows(a, b), rows(c, d)
        found = [enriched(x, theirs) for x in mine]
        found += supplemented(found, theirs)
        stay, gone = distinct(found)
        full = lambda r: (r["at"], r["words"], r["confidence"])
        return [full(r) for r in stay], [(full(k), full(g), score) for k, g, score in gone], len(found)

    def kept(self, found: list[tuple], names: list[str]) -> pa.StructArray:
        place, words = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
        column = lambda n: pa.array([x[2] for x in found], pa.float64()) if n == "confidence" else self.rows.field(n).take(words if n in ("text", "engine") else place)
        return pa.StructArray.from_arrays([column(n) for n in names], names)

    def removed(self, found: list[tuple]) -> pa.StructArray:
        pos = [pa.array([self.pos[x[i][0]] for x in found], pa.int32()) for i in (0, 1)]
        shown = [pa.array([preview(self.text[x[i][1]]) for x in found], pa.string()) for i in (0, 1)]
        return pa.StructArray.from_arrays([*pos, pa.array([x[2] for x in found], pa.float64()), *shown], ["kept_pos", "pos", "similarity", "kept_preview", "preview"])


def preview(text: str, most: int = 72) -> str:
    s = " ".join(text.split())
    return s if len(s) <= most else s[: most - 1] + "…"


def in_reading_order(layers: DataFrame, document_type: Column) -> Column:
    """kept, ordered as newspapers are read, or from the top down."""
    paper = document_type == "newspaper_front_page"

    def key(b: Column) -> Column:
        columns = paper & (b["block_type"] == "bottom_columns")
        rank = F.when(paper, looked_up({t: i for i, t in enumerate(READING_ORDER)}, b["block_type"], 99)).otherwise(0)
        return F.struct(rank.alias("r"), F.when(columns, b["x1"]).otherwise(b["y1"]).alias("a"), F.when(columns, b["y1"]).otherwise(b["x1"]).alias("b"), b["pos"].alias("p"), b.alias("block"))

    return F.transform(F.array_sort(F.transform("kept", key)), lambda x: x["block"])


def search_text(blocks: DataFrame, others: DataFrame | None = None, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, segments, full_text, removed, n_before, n_after): texts of the blocks kept, by line, in reading order."""
    layers = layer(blocks, others, w, h)
    out = layers.withColumn("kept", in_reading_order(layers, F.coalesce("document_type", F.lit("generic"))))
    out = out.withColumn("segments", F.transform("kept", lambda b: F.array_join(T.text_lines(b["text"]), "\n")))
    return out.select("page", "segments", F.array_join("segments", "\n\n").alias("full_text"), "removed", "n_before", F.size("segments").alias("n_after"))

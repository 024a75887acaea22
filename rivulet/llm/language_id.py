"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed byte n-grams of its lower-cased letters (other characters
count as one space), normalised to length one. Each language has several centroids, found by
spherical k-means on a bounded sample of labelled texts. A text gets the language of the centroid
with the largest cosine; it is rejected where even that one is far.

A cosine grows with the number of different n-grams, whatever the language. So what is far is
learned for each centroid and for each number of n-grams, from the labelled texts cut to many lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._scratch import ship
from rivulet.llm._tables import table

_BITS = 12
_ROWS, _CHARS = 128, 1 << 18
_HASHES = 1 << 30
_SIZES = 2 * _BITS + 1  # classes of texts by their different n-grams, two for each doubling
_FEW = 50  # cuts of a class, below which it is not told apart
_QUANTILE, _MARGIN = 0.005, 0.7
_LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def grams(text: str | None) -> np.ndarray:
    """Counts of hashed byte pairs, triples and quadruples."""
    a = _FOLD[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    blank = a == 32
    a = a[np.append(True, ~(blank[1:] & blank[:-1]))]
    x = a.astype(np.uint32)
    out = np.zeros(1 << _BITS, dtype=np.int64)
    held = x[:-1] << np.uint32(8) | x[1:]
    for k in range(2, 5):
        if len(x) < k:
            break
        if k > 2:
            held = held[:-1] << np.uint32(8) | x[k - 1 :]
        h = (held * np.uint32(2 * k + 0x9E3779B1)) >> np.uint32(32 - _BITS)
        out += np.bincount(h, minlength=1 << _BITS)
    return out


def sizes(counts: np.ndarray) -> np.ndarray:
    return (2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)


def cuts(text: str) -> list[str]:
    """The beginnings of a text, each about 1.4 times as long as the one before, and all of it."""
    lengths = [int(2 ** (k / 2)) for k in range(4, 80)]
    return [c for c in [text[:n] for n in lengths if n < len(text)] + [text] if has_letter(c)]


@dataclass
class Model:
    names: list
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid
    owner: np.ndarray  # of each centroid: position in names
    limits: np.ndarray  # cosine below which a text is rejected, by its centroid and size class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected: ``und`` where there is no letter."""
        counts = np.stack([grams(t) for t in texts])
        sims = self.vectors(counts) @ self.centroids.T
        best = sims.argmax(axis=1)
        out = []
        for t, b, s, least in zip(texts, best, sims, self.limits[best, sizes(counts)], strict=True):
            if not has_letter(t):
                out.append(("und", 0.0, True))
            else:
                score = float(min(1.0, max(0.0, s[b])))
                out.append((self.names[self.owner[b]], score, score < float(least)))
        return out


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):  # the vector farthest from those so far
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def _limits(found: list[tuple[int, int, float]], owner: np.ndarray, least: float) -> np.ndarray:
    """By centroid and size class, a share of a low quantile of the cosines of labelled texts, given as (centroid, class, cosine).

    A class with few cuts takes those of its language or of all languages, or else the limit of the
    class below it; texts smaller than any class are never rejected. ``least`` where no class has enough.
    """
    at, size, cosine = (np.array([r[k] for r in found]) for k in range(3))
    out = np.full((len(owner), _SIZES), least)
    if not len(found) or np.bincount(size).max() < _FEW:
        return out
    for c in range(len(owner)):
        held = 0.0
        for k in range(_SIZES):
            for same in (at == c, owner[at] == owner[c], at >= 0):
                group = cosine[same & (size == k)]
                if len(group) >= _FEW:
                    held = _MARGIN * float(np.quantile(group, _QUANTILE, method="lower"))
                    break
            out[c, k] = held
    return out


def fit(
    docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    per_language: int = 300, centroids: int = 4, least: float = 0.1,
) -> Model | None:
    """Fit on about ``per_language`` rows of each language among those where ``learn`` holds.

    The sample is drawn by a hash of the id, evenly from all rows; only n-gram counts of fixed
    size come to the driver, and the cosines of its texts cut to many lengths. Each text is held
    against its centroid without itself. None where there is nothing to learn from. ``least``: the
    cosine below which a text is rejected where there are too few texts to learn it.
    """
    ship(docs.sparkSession)
    known = docs.where(learn & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id), F.lit("lang")), F.lit(_HASHES)).alias("draw")
    )
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    least_draw = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, int(_HASHES * min(1.0, per_language / n)))])

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            data = [np.minimum(grams(texts[i]), 65535).astype("<u2").tobytes() for i in keep]
            yield pa.record_batch([batch.column("lang").take(pa.array(keep, pa.int64())), pa.array(data, pa.binary())], ["lang", "counts"])

    sample = known.where(F.col("draw") < F.element_at(least_draw, F.col("lang"))).select("lang", "text")
    rows = sample.mapInArrow(counted, "lang string, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    counts = np.stack([np.frombuffer(r["counts"], dtype="<u2") for r in rows])
    names = sorted({r["lang"] for r in rows})
    of = np.array([names.index(r["lang"]) for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(names, idf, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    vectors = model.vectors(counts)
    found = [_k_means(vectors[of == i], centroids) for i in range(len(names))]
    model.centroids = np.concatenate(found).astype(np.float32)
    model.owner = np.repeat(np.arange(len(names)), [len(c) for c in found])
    own = np.where(model.owner == of[:, None], vectors @ model.centroids.T, -1).argmax(axis=1)
    mass = np.array([np.linalg.norm(vectors[own == c].sum(axis=0)) for c in range(len(model.owner))])
    held = docs.sparkSession.sparkContext.broadcast((model, mass))

    def measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = held.value
        for batch in rows:
            out: tuple[list, list, list] = ([], [], [])
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                counts = np.stack([grams(c) for c in cuts(text)])
                x = model.vectors(counts)
                whole, sims = x[-1], x @ model.centroids.T
                c = int(np.where(model.owner == model.names.index(lang), sims[-1], -1).argmax())
                others = model.centroids[c] * mass[c] - whole
                norm = np.linalg.norm(others)
                sims[:, c] = x @ (others / norm) if norm > 1e-3 else -1
                best = sims.argmax(axis=1)
                out[0].extend(best.tolist())
                out[1].extend(sizes(counts).tolist())
                out[2].extend(sims[np.arange(len(best)), best].tolist())
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], ["centroid", "size", "cosine"])

    model.limits = _limits([tuple(r) for r in sample.mapInArrow(measured, "centroid int, size int, cosine double").collect()], model.owner, least)
    return model


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= _CHARS or i + 1 - begin >= _ROWS:
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (names after ``prefix``; they replace columns so named).

    Texts that are null or have no letter are ``und``, score 0 and are rejected; so are all texts
    where nothing was learned. Columns, repeated rows and row count stay.
    """
    held = ship(docs.sparkSession).sparkContext.broadcast(model)  # 16 KB for each centroid
    added = [(prefix + n, t) for n, t in (("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()))]
    names = [n for n in docs.columns if n not in dict(added)]
    at = names.index(text)

    def predicted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(at).to_pylist()
            out: list = []
            for _, part in _slices(texts):
                out += held.value.predict(part) if held.value else [("und", 0.0, True)] * len(part)
            columns = [pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(added)]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *dict(added)])

    schema = docs.select(*names).withColumns(dict(zip(dict(added), (F.lit(""), F.lit(0.0), F.lit(False)), strict=True))).schema
    for f in schema.fields:
        f.nullable = True
    return docs.select(*names).mapInArrow(predicted, schema)


def fold(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are far from every centroid; the model learns from their own ``lang``.

    All documents stay where nothing can be learned.
    """
    names = docs.columns
    model = fit(docs, F.lit(True))
    if model is None:
        return docs
    found = identify(docs, model, prefix="_rv_")
    return found.where(~F.col("_rv_rejected")).select(*names)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs, ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )

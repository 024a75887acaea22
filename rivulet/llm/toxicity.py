"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: one of ordinary texts, one trained on
windows of toxic texts. Everyday language has to cost the same under both, or its chance matches
drown what is toxic; so both stand behind the same ordinary background. A window of a text is
compressed under each, and the difference of the two lengths says how toxic it is.

Toxic texts are mostly everyday language, too. Which of their windows the dictionary is trained on
is decided by the same distance: a window stays while a dictionary of the windows from other
toxic texts compresses it better than the ordinary one, round by round. A threshold for windows and one for texts are calibrated on labelled texts that neither
dictionary has seen.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._scratch import ship
from rivulet.llm._tables import table
from rivulet.llm._text import batches
from rivulet.llm.language_id import fold

_WORD = re.compile(r"[^\W_]+")
_WINDOW = 5  # words that are compressed together
_MINED = ((2, 3, 6, 2, 1), (3, 2, 3, 4, 1))
_TOXIC_BYTES = 2_048
_INDEX = 21  # bits of the largest tables of positions
_HASHES = 1 << 30


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(found: list[str], n: int = _WINDOW) -> list[bytes]:
    return [(" " + " ".join(found[i : i + n]) + " ").encode() for i in range(0, len(found), n)]


def _compressor(data: bytes):
    bits = min(_INDEX, max(12, len(data).bit_length()))
    held = zstandard.ZstdCompressionParameters(
        window_log=bits + 1, hash_log=bits, chain_log=bits, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_DFAST,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=held)
    return zstandard.ZstdCompressor(compression_params=held, dict_data=d).compress


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes  # what stands behind the ordinary background in the toxic dictionary
    window_cut: float = 0.0  # bytes saved on a window that do not count
    text_cut: float = 1.0
    spread: float = 1.0
    _made: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}

    def saved(self, text: str | None) -> np.ndarray:
        """Of each window: its length under the ordinary dictionary less that under the toxic one."""
        if self._made is None:
            self._made = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        plain, toxic = self._made
        return np.array([len(plain(x)) - len(toxic(x)) for x in windows(words(text))], dtype=np.int64)

    def distance(self, saved: np.ndarray, cut: float | None = None) -> float:
        """Bytes saved above the window threshold, over the root of the number of windows (which chance grows with)."""
        cut = self.window_cut if cut is None else cut
        return float(np.maximum(saved - cut, 0).sum() / max(1, len(saved)) ** 0.5)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0.5 at the threshold for texts, above it beyond."""
        found = np.array([self.distance(self.saved(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip((found - self.text_cut) / self.spread, -30, 30)))


def _novel(texts: list[str]) -> list[list[str]]:
    """Words of the texts, without texts that share over 30 % of their word triples with earlier ones."""
    seen: set[str] = set()
    out = []
    for t in texts:
        w = words(t)
        own = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        if w and len(own & seen) <= 0.3 * len(own):
            out.append(w)
        seen |= own
    return out


def mined(texts: list[list[str]], ordinary: bytes) -> list[bytes]:
    """Windows of toxic texts that a dictionary of other toxic texts' windows compresses better than the ordinary one.

    Each of ``_MINED`` says: words of a window, bytes to save, rounds, parts that the texts are
    dealt into, and of how many other parts the dictionary is made.
    """
    out: list[bytes] = []
    plain = _compressor(ordinary)
    for n, least, rounds, parts, others in _MINED:
        held = [(i, x) for i, t in enumerate(texts) for x in windows(t, n)]
        length = {x: len(plain(x)) for x in {x for _, x in held}}
        for r in range(rounds):
            part = np.random.default_rng(r).permutation(len(texts)) % parts
            stays = np.zeros(len(held), dtype=bool)
            for p in range(parts):  # one dictionary in memory at a time
                toxic = _compressor(ordinary + b"".join(x for i, x in held if 0 < (part[i] - p) % parts <= others))
                for k, (i, x) in enumerate(held):
                    if part[i] == p:
                        stays[k] = length[x] - len(toxic(x)) >= least
            held = [w for w, stay in zip(held, stays.tolist(), strict=True) if stay]
        out += [x for _, x in held]
    return out


def _trained(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(_TOXIC_BYTES, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-_TOXIC_BYTES:]


def dictionaries(toxic: list[str], ordinary: list[str], background: int = 4 << 20) -> Model:
    """``background``: bytes of ordinary text at most."""
    plain = b"".join(b"".join(windows(t, 1 << 30)) for t in _novel(ordinary))[-background:] or b" "
    return Model(plain, _trained(mined(_novel(toxic), plain)) or b" ")


def calibrate(model: Model, texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Set the two thresholds to those of the best (weighted) F1 on labelled texts."""
    saved = [model.saved(t) for t in texts]
    best = (-1.0,)
    for cut in (0, 1, 2, 3):
        found = np.array([model.distance(s, cut) for s in saved])
        order = np.argsort(-found, kind="stable")
        hit, miss = np.cumsum((weight * toxic)[order]), np.cumsum((weight * (1 - toxic))[order])
        last = np.append(np.flatnonzero(np.diff(found[order])), len(found) - 1)  # texts of one distance go together
        f1 = (2 * hit / np.maximum(hit + miss + (weight * toxic).sum(), 1e-9))[last]
        at = int(f1.argmax())
        low = found[order[min(last[at] + 1, len(found) - 1)]]
        best = max(best, (float(f1[at]), -cut, max((found[order[last[at]]] + low) / 2, 1e-6), max(float(found[toxic == 0].std()), 1e-3)))
    _, cut, model.text_cut, model.spread = best
    model.window_cut = -cut
    return model


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, *, text: str = "text", toxic_texts: int = 2_500, ordinary_texts: int = 4_000,
    sample_bytes: int = 64 << 20,
) -> Model | None:
    """Fit on about so many labelled texts of each kind among the labels where ``learn`` (of doc_id) holds.

    The sample is drawn by a hash of the id, evenly over all labelled texts; the parameters bound
    its rows and, for each kind, its bytes. Two thirds of it make the dictionaries, the rest
    calibrates. None where a kind is missing.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = known.select("_id", (F.col("_toxic") > 0).cast("int").alias("_toxic"), F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(_HASHES)).alias("_draw"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col(text).alias("_text"))
    sizes = texts.select("_doc", F.octet_length("_text").alias("_size")).join(known, F.col("_doc") == F.col("_id"))  # no text is shuffled
    totals = {r["_toxic"]: (r["n"], r["size"]) for r in sizes.groupBy("_toxic").agg(F.count("*").alias("n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("size")).collect()}
    if set(totals) != {0, 1}:
        return None
    below = [int(_HASHES * min(1.0, most / totals[k][0], sample_bytes / max(1, totals[k][1]))) for k, most in ((0, ordinary_texts), (1, toxic_texts))]
    drawn = known.where(F.col("_draw") < F.when(F.col("_toxic") == 1, below[1]).otherwise(below[0])).select("_id", "_toxic")  # about as many ids as texts
    rows = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("_doc", "_toxic", "_text").collect()
    rows = sorted(((r["_doc"], r["_text"] or "", r["_toxic"]) for r in rows))
    random.Random(5).shuffle(rows)
    held = rows[::3]
    used = [r for i, r in enumerate(rows) if i % 3]
    y = np.array([float(r[2]) for r in held])
    if len(set(y)) < 2:
        return None
    model = dictionaries([r[1] for r in used if r[2]], [r[1] for r in used if not r[2]])
    return calibrate(model, [r[1] for r in held], y, np.where(y == 1, totals[1][0] / y.sum(), totals[0][0] / (1 - y).sum()))


def score_toxicity(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), which replace columns so named.

    Null texts count as empty; empty texts have no windows and get the score of saving nothing.
    Where nothing was learned all scores are 0. Columns, repeated rows and row count stay.
    """
    held = ship(docs.sparkSession).sparkContext.broadcast(model)  # 4 MB of background and the toxic dictionary at most
    names = [n for n in docs.columns if n not in ("score", "predicted")]

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [held.value.score(part) if held.value else np.zeros(len(part)) for _, part in batches(batch, text)]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = docs.select(*names).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    for f in schema.fields:
        f.nullable = True
    return docs.select(*names).mapInArrow(scored, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)
    held_out = fold(F.col("doc_id"), 5) == 0
    return score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")

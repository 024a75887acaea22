"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The test items are the indexed documents, every training passage is a query. An item is
retrieved where its score reaches a share of the score that its own text gets; scores and bounds
are divided by that item's threshold, so that one bound (1.0) holds for all items. Retrieved
items are verified: enough of the question and of the answer must stand in the passage.

Passages are searched in batches. WAND's pivot test - can the maxima of the terms at hand reach the
bound? - is made for all blocks of items that a passage's terms occur in; postings are read only in
blocks that pass, and an item is scored in full only where its own postings do. The terms that are
tested are each item's heaviest ones: what its other terms can add is taken off its threshold first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._scratch import save, ship
from rivulet.llm._tables import table
from rivulet.llm._text import batches, shingles, word_hashes

K1, B = 1.2, 0.75
_SPAN = 32  # items in one block
_BLOCK_WORDS = 1_000_000  # words of test items in one broadcast index
_OVERLAP_WORDS = 3
_LIGHT = 0.3  # of an item's threshold: what its light terms weigh together at most
_ENTRIES = 1 << 18  # (passage, block) entries at a time


@dataclass
class Index:
    """Inverted index of a bounded number of items; weights are shares of the item's threshold."""

    items: list
    vocabulary: np.ndarray  # sorted word hashes
    term_begin: np.ndarray  # of each item's terms, heaviest or not
    term: np.ndarray
    weight: np.ndarray
    block_of_term: np.ndarray  # of each term's blocks
    block: np.ndarray  # number of the block: which items it holds
    block_max: np.ndarray
    posting_of_block: np.ndarray  # of each block's postings
    posting_item: np.ndarray
    posting_weight: np.ndarray  # as a share of what the item's heaviest terms have to reach
    window: int
    runs: list  # of each item: its (words of a run, hashes of the question's runs, of the answer's runs)
    share: float
    overlap: float


def item_terms(items: DataFrame) -> DataFrame:
    """(item, n_words, term, tf) of items given as (item, question, answer)."""

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column("item").to_pylist()
            both = [f"{q or ''} {a or ''}" for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), strict=True)]
            words, first = word_hashes(both)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, item in enumerate(ids):
                terms, tf = np.unique(words[first[i] : first[i + 1]], return_counts=True)
                out[0].extend([item] * len(terms))
                out[1].extend([int(first[i + 1] - first[i])] * len(terms))
                out[2].extend(terms.view(np.int64).tolist())
                out[3].extend(tf.tolist())
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["item", "n_words", "term", "tf"])

    return items.mapInArrow(split, "item long, n_words long, term long, tf long")


def halves(text: Column) -> tuple[Column, Column]:
    """Question and answer of a test item that is one text: the first and the second half of its words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.ceil(F.size(words) / 2).cast("int")
    return F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, n + 1, F.size(words)), " ")


def indexes(items: DataFrame, share: float, overlap: float) -> Iterator[Index]:
    """One index after the other, each of about ``_BLOCK_WORDS`` words; document frequencies are those of all items."""
    ship(items.sparkSession)
    # an item is its id and text: rows without an id, or with one id and several texts, are items of their own
    items = items.select(F.col("item").alias("id"), "question", "answer").distinct()
    items = items.withColumn("item", F.xxhash64("id", F.col("id").isNull(), F.coalesce("question", F.lit("")), F.lit(0), F.coalesce("answer", F.lit(""))))
    terms = save(item_terms(items), "item-terms")
    totals = terms.groupBy("item").agg(F.first("n_words").alias("n_words")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")
    ).first()
    if not totals["n"]:
        return
    n_blocks = -(-totals["words"] // _BLOCK_WORDS)
    df = terms.groupBy("term").agg(F.countDistinct("item").alias("df"))
    rows = (
        terms.join(df, "term")
        .groupBy("item").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("term", "tf", "df")).alias("terms"))
        .join(items.groupBy("item").agg(F.first("id").alias("id"), F.first("question").alias("question"), F.first("answer").alias("answer")), "item")
        .withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    )
    rows = save(rows, "item-rows") if n_blocks > 1 else rows
    for block in range(n_blocks):  # each collects a bounded number of words
        if found := rows.where(F.col("block") == block).collect():
            yield build_index(found, totals["n"], totals["words"] / totals["n"], share, overlap)


def _runs(question: str | None, answer: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Runs of words of both parts. An item with fewer words than two runs is one run of all its words."""
    words, first = word_hashes([question, answer])
    if len(words) < 2 * _OVERLAP_WORDS:
        whole = shingles(words, np.array([0, len(words)]), max(1, len(words)))[0]
        return len(words), whole, whole
    n = max(1, min(_OVERLAP_WORDS, *(k for k in np.diff(first).tolist() if k)))
    found, at = shingles(words, first, n)
    return n, np.unique(found[: at[1]]), np.unique(found[at[1] :])


def build_index(rows: list, n_items: int, mean_words: float, share: float, overlap: float) -> Index:
    weights = []
    for r in rows:
        long = K1 * (1 - B + B * r["n_words"] / mean_words)
        w = {t["term"]: np.log(1 + (n_items - t["df"] + 0.5) / (t["df"] + 0.5)) * t["tf"] * (K1 + 1) / (t["tf"] + long) for t in r["terms"]}
        weights.append((share * sum(w.values()), w, r))
    weights.sort(key=lambda x: (min(x[1], key=lambda t: (-x[1][t], t)), x[2]["item"]))  # items with one heaviest term stand together: fewer blocks
    count = np.array([len(w) for _, w, _ in weights])
    item = np.repeat(np.arange(len(weights)), count)
    vocabulary, term = np.unique(np.array([t for _, w, _ in weights for t in w], dtype=np.int64).view(np.uint64), return_inverse=True)
    value = np.array([v / least for least, w, _ in weights for v in w.values()])

    order = np.lexsort((value, item))  # lightest first
    upto = np.cumsum(value[order])
    upto -= np.repeat(np.append(0.0, upto)[np.cumsum(count) - count], count)
    light = np.empty(len(item), dtype=bool)
    light[order] = upto < _LIGHT
    rest = np.bincount(item[light], weights=value[light], minlength=len(weights))
    key = np.flatnonzero(~light)  # a passage that reaches the threshold of 1 has 1 less that rest from these
    key = key[np.lexsort((item[key], term[key]))]
    key_term, key_item, key_weight = term[key], item[key], value[key] / (1.0 - rest[item[key]] - 1e-9)
    block = key_item // _SPAN
    new = np.flatnonzero(np.append(True, (key_term[1:] != key_term[:-1]) | (block[1:] != block[:-1])))
    longest = max(r["n_words"] for _, _, r in weights)
    return Index(
        [r["id"] for _, _, r in weights], vocabulary, np.append(0, np.cumsum(count)), term, value,
        np.searchsorted(key_term[new], np.arange(len(vocabulary) + 1)), block[new], np.maximum.reduceat(key_weight, new), np.append(new, len(key)), key_item, key_weight,
        2 * longest, [_runs(r["question"], r["answer"]) for _, _, r in weights], share, overlap,
    )


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and which range each is of."""
    count = end - begin
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(np.arange(len(count)), count)


def block_max_wand(index: Index, query: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
    """(query, item, score) of all items that reach their thresholds; ``query`` and ``term``: distinct pairs, sorted."""
    found, n_blocks, n_items = [], int(index.block.max()) + 1, len(index.items)
    entries = index.block_of_term[term + 1] - index.block_of_term[term]
    last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, dtype=np.int64)
    upto = np.cumsum(entries)
    low = 0
    while low < len(query):  # so many whole queries that their entries stay bounded
        full = last[upto[last] <= (upto[low - 1] if low else 0) + _ENTRIES]
        high = int(full[-1]) + 1 if len(full) and full[-1] >= low else int(last[np.searchsorted(last, low)]) + 1
        entry, of = _spread(index.block_of_term[term[low:high]], index.block_of_term[term[low:high] + 1])
        q = query[low:high][of]
        pair, where = np.unique(q * n_blocks + index.block[entry], return_inverse=True)
        bound = np.bincount(where, weights=index.block_max[entry], minlength=len(pair))
        live = bound[where] >= 1.0  # the pivot test: no item of the others can reach its threshold
        posting, of = _spread(index.posting_of_block[entry[live]], index.posting_of_block[entry[live] + 1])
        pair, where = np.unique(q[live][of] * n_items + index.posting_item[posting], return_inverse=True)
        score = np.bincount(where, weights=index.posting_weight[posting], minlength=len(pair))
        for x in pair[score >= 1.0].tolist():
            k, item = divmod(x, n_items)
            terms = term[np.searchsorted(query, k) : np.searchsorted(query, k, side="right")]
            own = slice(index.term_begin[item], index.term_begin[item + 1])
            total = float(index.weight[own][np.isin(index.term[own], terms)].sum())
            if total >= 1.0:
                found.append((k, item, total))
        low = high
    return found


def leaks(index: Index, texts: list[str | None]) -> dict[int, list[tuple]]:
    """For the number of a text: (item, score as a share of the item's own, question and answer overlap, first word)."""
    out: dict[int, list[tuple]] = {}
    words, first = word_hashes(texts)
    if not len(words):
        return out
    term = np.searchsorted(index.vocabulary, words)
    term[term == len(index.vocabulary)] = 0
    known = np.flatnonzero(index.vocabulary[term] == words)
    step = index.window // 2
    count = np.diff(first)
    windows = np.maximum(1, -(-count // step) - 1)
    first_window = np.cumsum(windows) - windows
    which = np.repeat(np.arange(len(texts)), windows)
    at = (np.arange(len(which)) - first_window[which]) * step + first[which]
    end = np.minimum(at + index.window, first[which + 1])
    text = np.searchsorted(first, known, side="right") - 1
    place = (known - first[text]) // step  # a word stands in the passage that begins there and in the one before
    inside = np.concatenate([np.minimum(place, windows[text] - 1), np.maximum(np.minimum(place, windows[text]) - 1, 0)]) + np.tile(first_window[text], 2)
    pair = np.unique(inside * len(index.vocabulary) + np.tile(term[known], 2))
    runs: dict[tuple[int, int], np.ndarray] = {}
    for k, item, score in block_max_wand(index, *np.divmod(pair, len(index.vocabulary))):
        n, question, answer = index.runs[item]
        if (k, n) not in runs:
            runs[k, n] = shingles(words[at[k] : end[k]], np.array([0, end[k] - at[k]]), n)[0]
        share = [float(np.isin(x, runs[k, n]).mean()) if len(x) else 1.0 for x in (question, answer)]
        if min(share) >= index.overlap:
            i = int(which[k])
            best = [x for x in out.get(i, []) if x[0] != index.items[item]]
            same = [x for x in out.get(i, []) if x[0] == index.items[item]]
            new = (index.items[item], score * index.share, *share, int(at[k] - first[i]))
            out[i] = best + [max([*same, new], key=lambda x: (x[1], -x[4]))]
    return out


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """One row per document and test item found in it.

    ``items`` has (item long, question, answer). ``share``: of an item's own BM25 score that a
    passage must reach; ``overlap``: of the three-word runs of question and answer, each, that
    must stand in the passage. Passages overlap by the longest item, so an item is never cut.
    An item is its id and text, so null ids and ids with several texts lose no passage; a document
    has one row for an id, that of the highest score. An item of fewer than six words has to stand
    word for word. Null and empty texts match nothing; repeated rows give repeated results; empty
    tables give none; further columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for index in indexes(items, share, overlap):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def search(rows: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                ids = batch.column("doc_id").to_pylist()
                for begin, texts in batches(batch, "text"):
                    out = [(ids[begin + i], *x) for i, xs in sorted(leaks(held.value, texts).items()) for x in xs]
                    if out:
                        yield pa.record_batch([pa.array(c, pa.int64() if n in ("doc_id", "item_id", "first_word") else pa.float64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

        parts.append(slim.mapInArrow(search, schema))
    if not parts:
        return docs.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", share: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The documents without those in which a test item is found; all columns stay, no join is needed.

    Null and empty texts stay, so do all documents where there are no items. Repeated rows share
    their fate; empty tables stay empty.
    """
    at = docs.columns.index(text)
    for index in indexes(items, share, overlap):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def keep(rows: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                clean = np.ones(batch.num_rows, dtype=bool)
                only = pa.record_batch([batch.column(at)], ["text"])
                for begin, texts in batches(only, "text"):
                    clean[[begin + i for i in leaks(held.value, texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, answer = halves(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item"), question.alias("question"), answer.alias("answer"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), benchmark_items(spark, sf_dir))

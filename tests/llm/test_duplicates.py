import random

from llm_helpers import near_duplicates as brute_near
from llm_helpers import removed as brute_removed
from pyspark.sql import functions as F

from rivulet.llm import near_duplicates as forest
from rivulet.llm import substring_dedup as substrings
from rivulet.llm.near_duplicates import components, keep_first, near_duplicates, shortest_prefix
from rivulet.llm.substring_dedup import remove_repeats


def _family(seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 90]))]
        for _ in range(r.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += r.choice([1, 2])
    return [*rows, (900, rows[0][1]), (901, None), (902, ""), (903, "few words"), (904, "Few, words!"), (None, rows[0][1])]


def _near(df):
    return sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "class_id", "n_links").collect()), key=repr)


def test_near_duplicates_against_all_pairs(spark):
    rows = _family()
    assert _near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


def test_near_duplicates_of_many(spark):
    """More nodes under one prefix than a block holds: pairs of blocks lose no link."""
    r = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(700):
        copy = list(base)
        copy[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    facts = got.agg(F.min("class_id"), F.max("class_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(facts) == (0, 0, 699, 699)


def test_near_duplicates_of_the_documents_against_all_pairs(spark, sf_dir):
    """All links of the given table, whatever the estimate says: recall 1."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, forest.op9_near_duplicates(spark, sf_dir).collect())) == sorted(brute_near(rows))


def test_recall_decides_how_far_prefixes_are_shortened():
    assert shortest_prefix(0.8, 0.9999) < shortest_prefix(0.95, 0.9999) and shortest_prefix(0.8, 1.1) == 1
    near, far = [100] + [0] * 19, [0] * 19 + [100]
    assert forest.estimated_recall(far, 8, 0.8) > 0.9999 > forest.estimated_recall(near, 8, 0.8)  # close copies need no shorter prefix
    found = [forest.estimated_recall(near, 8, 0.8, k) for k in range(8, 4, -1)]
    assert found == sorted(found) and found[-1] > 0.9999 and forest.estimated_recall([0] * 20, 8, 0.8) == 0


def test_only_branching_prefixes_bring_new_pairs(spark):
    key = lambda *x: b"".join(v.to_bytes(2, "big") for v in x)
    rows = [(n, i, 1, 9, 0, key(1, 2, 3, 4, 5, *end)) for i, (n, end) in enumerate({"a": (1, 1, 1), "b": (1, 1, 1), "c": (2, 1, 1), "d": (3, 3, 3)}.items())]
    rows += [("a", 0, 1, 9, 1, key(*range(8))), ("b", 1, 1, 9, 1, key(*range(8))), ("e", 4, 1, 9, 1, key(*range(1, 9)))]
    matched = spark.createDataFrame(rows, "node string, first long, copies long, shingles long, tree int, key binary")
    longest = {r["node"]: len(r["at"]) for r in forest._candidates(matched, 8, None).collect()}
    assert longest == {"a": 1, "b": 1}  # the same pair in both trees is one group
    shorter = {r["node"]: len(r["at"]) for r in forest._candidates(matched, 5, 8).collect()}
    assert shorter == {"a": 1, "b": 1, "c": 1, "d": 1}
    parts = forest._candidates(matched, 5, 8, (1, 1 << 20)).collect()  # blocks of one node
    assert {r["node"]: len(r["at"]) for r in parts} == {"a": 4, "b": 4, "c": 4, "d": 4}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z0")], "node string, other string")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert set(found.values()) == {"n000", "z0"} and len(found) == 63


def test_components_of_a_large_star(spark):
    """A node with most of all edges is dealt out by a further hash."""
    edges = spark.range(4000).select(F.format_string("n%05d", F.col("id") + 1).alias("node"), F.lit("n00000").alias("other"))
    found = components(edges.unionByName(spark.createDataFrame([("y", "x")], "node string, other string")))
    assert {(r["root"], r["count"]) for r in found.groupBy("root").count().collect()} == {("n00000", 4001), ("x", 2)}


def test_odd_documents_near(odd, empty):
    assert near_duplicates(odd).count() == odd.count() and near_duplicates(empty).count() == 0
    kept = keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2 and keep_first(empty).count() == 0


def _gone(df, **more):
    return sorted((tuple(r) for r in remove_repeats(df, keep_bytes=False, **more).collect()), key=repr)


def test_removed_substrings_against_all_windows(spark):
    r = random.Random(3)
    parts = ["".join(r.choice(["ab", "the", " ", "é", "of "]) for _ in range(r.choice([5, 40, 200]))) for _ in range(9)]
    rows = [(i, "".join(r.choice(parts)[r.randrange(60) :] for _ in range(r.randrange(1, 5)))) for i in range(60)]
    rows += [(5, "a" * 300), (7, "a" * 200), (None, "a" * 99), (None, None), (80, ""), (3, rows[9][1]), (9, rows[9][1]), (70, rows[9][1])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removed(rows)
    assert _gone(df) == want
    assert _gone(df, block_bytes=700, hot_blocks=3) == want


def test_copies_inside_blocks_and_pieces_repeated_in_one_document(spark):
    """What a block settles itself (copies, further pieces of its smallest document) and what other blocks add."""
    r = random.Random(5)
    x, y = ("".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in range(2))
    rows = [(40 + i, x + y[: 50 * i]) for i in range(12)] + [(30, x + x + y + x), (20, y + "z" * 120 + y + x[700:]), (30, x), (10, x[:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_removed(rows)
    for block_bytes in (9_000, 1 << 20):
        assert _gone(df, block_bytes=block_bytes) == _gone(df, block_bytes=block_bytes, hot_blocks=2) == want


def test_a_block_sends_each_piece_once(spark):
    r = random.Random(6)
    x = "".join(r.choice("abcdefgh ") for _ in range(5000))
    sent = []
    for copies in (2, 40):
        df = spark.createDataFrame([(i, x) for i in range(copies)], "doc_id long, text string").coalesce(1)
        sent.append(substrings._digests(substrings._pack(df, 1 << 30), 50, 8).agg(F.sum(F.length("digests"))).first()[0])
    assert sent[0] == sent[1] > 0


def test_odd_documents_removed(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _gone(odd) == brute_removed(rows) and _gone(empty) == []
    kept = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(odd).collect()}
    assert kept[5] == b"" and kept[1].startswith(b"The quick")

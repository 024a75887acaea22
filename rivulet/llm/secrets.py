"""Secret scans with corpus-wide ownership frequency, in Spark SQL expressions only.

Candidates are found by pattern; their values are counted over the whole corpus by distinct
repositories (documents) and owners (sources). A value that many owners or very many repositories
hold is a copied example; one that few hold is theirs and looks live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._scratch import save
from rivulet.llm._tables import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
_ANY = (
    r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|(?<![0-9a-f])[0-9a-f]{24}"""
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20})"
)
_KINDS = ("assign", "access", "hex", "token")
MAX_OWNERS, MAX_REPOSITORIES = 2, 1000
_MARK, _OTHER = "\ue000", "\ue001"  # characters that no pattern matches; of equal length in every count
_RUN = 128  # matches whose places are summed at once
_STEPS = 20  # of a search by halving: up to a million spans in a text
_EMPTY = "array<struct<start:int,end:int,kind:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often lambdas inside look at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Every match's start, end (code points, end exclusive), kind and value, in order.

    Matches are marked in one pass and the text is cut at the marks, so that gaps and matches take
    turns. Their places are sums of lengths, made in runs of ``_RUN`` matches and over whole runs:
    an array that grows match by match would be copied once a match.
    """
    clean = F.translate(text, _MARK, _OTHER)
    cut = F.split(F.regexp_replace(clean, F.lit(f"({pattern})"), F.lit(f"{_MARK}$1{_MARK}")), _MARK, -1)

    def found(pieces: Column) -> Column:  # gap, match, gap, match... gap
        n = F.floor(F.size(pieces) / 2).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), F.ceil(n / _RUN).cast("int") - 1),
            lambda k: F.slice(pieces, k * (2 * _RUN) + 1, F.least(F.lit(2 * _RUN), 2 * n - k * (2 * _RUN))),
        )
        return F.when(n > 0, _let(runs, placed)).otherwise(F.array().cast(_EMPTY))

    def placed(runs: Column) -> Column:
        size = F.transform(runs, lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + F.length(y)))
        starts = F.aggregate(size, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.flatten(_let(starts, lambda at: F.transform(runs, lambda x, k: run(x, F.get(at, k)))))

    def run(pieces: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x)
            value = x if not group else F.regexp_extract(x, pattern, group)
            one = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
            out = F.when(acc["match"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
            return F.struct(end.alias("at"), (~acc["match"]).alias("match"), out.alias("out"))

        zero = F.struct(at.alias("at"), F.lit(False).alias("match"), F.array().cast(_EMPTY).alias("out"))
        return F.aggregate(pieces, zero, step, lambda acc: acc["out"])

    return _let(cut, found)


def _overlaps(spans: Column, s: Column) -> Column:
    """Whether a span of an ordered array without overlaps meets ``s``: the last one that begins before its end."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_STEPS))])
    n = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(spans, at + k - 1)["start"] < s["end"], at + k).otherwise(at))
    return F.coalesce(F.get(spans, n - 1)["end"] > s["start"], F.lit(False))


def suspicious(text: Column) -> Column:
    """Whether any pattern can match; all others have no spans."""
    return F.coalesce(text, F.lit("")).rlike(_ANY)


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", all_hit: bool = False) -> DataFrame:
    """One slim row per document: id, text_key, owner, ``base`` and further ``tokens`` spans."""
    body = F.coalesce(F.col(text), F.lit(""))
    hit = F.lit(True) if all_hit else suspicious(F.col(text))
    none = F.array().cast(_EMPTY)
    mixed = F.filter(
        _spans(body, TOKEN, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    )
    kinds = {
        "assign": F.filter(_spans(body, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 6),
        "access": _spans(body, ACCESS, 1), "hex": _spans(body, HEX, 2), "mixed": mixed,
    }
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(body).alias("text_key"),
        F.coalesce(F.col(owner), F.lit("")).alias("owner"),
        *[F.when(hit, x).otherwise(none).alias(k) for k, x in kinds.items()],
    )
    free = _let(
        F.struct("assign", "access", "hex"),
        lambda by: F.filter("mixed", lambda s: ~(_overlaps(by["assign"], s) | _overlaps(by["access"], s) | _overlaps(by["hex"], s))),
    )
    return slim.select(
        "doc_id", "text_key", "owner", F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.when(F.size("mixed") > 0, free).otherwise(F.col("mixed")).alias("tokens"),
    )


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Distinct owners and repositories of every candidate value in the corpus, and whether it looks live."""
    each = found.select(
        "owner", "doc_id", F.explode(F.concat("base", "tokens")).alias("s")
    ).select("owner", "doc_id", F.sha2("s.value", 256).alias("value_hash"))
    return (
        each.groupBy("value_hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
        .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    )


def scan(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Spans of every document that has any: (doc_id, text_key, spans with owners, repositories, live, added).

    ``found`` is what :func:`candidates` gives. Base spans always stay; a further token span is
    added where its value looks live. Values are joined by hash, so a value that a third of all
    documents hold is split by Spark's skew join.
    """
    spans = (
        found.select(
            "doc_id", "text_key",
            F.explode(F.concat(
                F.transform("base", lambda s: s.withField("added", F.lit(False))),
                F.transform("tokens", lambda s: s.withField("added", F.lit(True))),
            )).alias("s"),
        )
        .select("doc_id", "text_key", "s.*", F.sha2("s.value", 256).alias("value_hash"))
        .join(ownership(found, max_owners, max_repositories), "value_hash")
        .where(~F.col("added") | F.col("live"))
    )
    return spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "kind", "end", "value_hash", "owners", "repositories", "live", "added"))).alias("spans")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def scan_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per input row with counts by kind, all spans, and ``ownership``: of each span in
    order ``owners/repositories``, with ``/live`` where its value looks live.

    Null texts are empty and have no spans; a null owner is an owner of its own, null ids are one
    repository; repeated rows give repeated result rows and count as one repository; further
    columns are ignored; empty tables give no rows.
    """
    found = save(candidates(docs, doc_id=doc_id, text=text, owner=owner), "secrets")
    spans = scan(found).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("all"))
    joined = found.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    base = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    owners = F.transform("all", lambda s: F.concat(F.concat_ws("/", s["owners"], s["repositories"]), F.when(s["live"], "/live").otherwise("")))
    return joined.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce(F.array_join(owners, ","), F.lit("")).alias("ownership"),
    )


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", mark: str = "[SECRET]", max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` with every live-looking credential replaced by ``mark``; copied examples stay.

    An example is held by more than two owners or more than ``max_repositories`` documents.

    Every text is searched once, and written with whether anything was found: only rows with
    candidates are searched for their places and joined with the corpus counts. Columns and row
    count stay; null texts stay null; repeated rows share their fate; empty tables stay empty.
    """
    names = docs.columns
    flagged = save(docs.withColumn("_rv_hit", suspicious(F.col(text))), "flagged")
    hits, rest = flagged.where("_rv_hit"), flagged.where("NOT _rv_hit")
    found = save(candidates(hits, doc_id=doc_id, text=text, owner=owner, all_hit=True), "secrets")
    live = scan(found, max_repositories=max_repositories).select(
        F.col("doc_id").alias("_rv_id"), F.col("text_key").alias("_rv_key"), F.filter("spans", lambda s: s["live"]).alias("_rv_spans")
    ).where(F.size("_rv_spans") > 0)
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:  # overlapping spans are replaced together
        piece = F.struct(acc["at"].alias("at"), s["start"].alias("to"))
        return F.when(s["start"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["gaps"], F.array(piece)).alias("gaps"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["gaps"].alias("gaps"))
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,to:int>>").alias("gaps"))
    kept = F.aggregate("_rv_spans", zero, step, lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("at"), F.length(body).alias("to")))))
    leading = F.when(F.element_at("_rv_kept", 1)["at"] > 0, F.lit(mark)).otherwise(F.lit(""))
    masked = F.concat(leading, F.array_join(F.transform("_rv_kept", lambda p: F.substr(body, p["at"] + 1, p["to"] - p["at"])), mark))
    joined = hits.join(
        live,
        F.col(doc_id).eqNullSafe(F.col("_rv_id")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("_rv_key")),
        "left",
    ).withColumn("_rv_kept", kept).withColumn(text, F.when(F.col("_rv_spans").isNotNull(), masked).otherwise(body))
    return joined.select(*names).unionByName(rest.select(*names))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS repository, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
m AS (
  SELECT rid, 0 AS kind, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS found,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS value,
    string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), string_split_regex(text, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM d
), u AS (
  SELECT rid, kind, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS f, unnest(value) AS v, unnest(gaps[1:len(found)]) AS g FROM m WHERE len(found) > 0
), p AS (
  SELECT *, sum(length(g) + length(f)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM u
), s AS (
  SELECT rid, kind, (stop - length(f))::BIGINT AS start, stop::BIGINT AS stop, v, f FROM p
  WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(f) >= 20
    WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') ELSE true END
), k AS (
  SELECT * FROM s WHERE kind < 3
  UNION ALL SELECT * FROM s a WHERE kind = 3 AND NOT EXISTS (
    SELECT 1 FROM s b WHERE b.rid = a.rid AND b.kind < 3 AND a.start < b.stop AND a.stop > b.start)
), o AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM k JOIN d USING (rid) GROUP BY v
), r AS (
  SELECT *, owners <= 2 AND repositories <= 1000 AS live FROM k JOIN o USING (v)
), n AS (
  SELECT rid, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS item, kind, start, stop,
    owners || '/' || repositories || CASE WHEN live THEN '/live' ELSE '' END AS owned FROM r WHERE kind < 3 OR live
), a AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(item, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(item, ',' ORDER BY start, kind, stop) AS spans,
    string_agg(owned, ',' ORDER BY start, kind, stop) AS ownership
  FROM n GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership
FROM d LEFT JOIN a USING (rid)
"""

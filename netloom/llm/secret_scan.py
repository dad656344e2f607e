"""Secret scans with corpus-wide ownership frequency, in Spark expressions alone.

Candidates of four kinds, leftmost and not overlapping within a kind: ``assign`` (a value given to a password, secret, token or key), ``access``
(AKIA...), ``hex`` (32 digits or more) and ``opaque`` (a long run of letters and digits mixed, outside the others). A candidate's value is hashed
and its owners counted over the whole corpus: distinct owners, and distinct repositories in all of them. A value that more than ``max_owners``
own, or that stands in more than ``max_repositories`` repositories whoever owns them, is a widely copied example; others look live. Spans of the first three kinds are always reported; an opaque run is one only if it
looks live, as that is all that tells it from an example or an identifier.

Offsets are code points, ends exclusive. Where a match stands is a running sum over its text's matches. Values are reduced by (value, owner,
repository) before they are counted, and the join back to the matches is of two written tables, in which Spark splits a frequent value. Spans
that tie in their start come in the order of kinds. Texts are read whole; one with many matches costs time in proportion to them. Null texts count as empty; a null owner or repository counts as an owner or repository of its own; repeated
rows and ids are rows of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.scratch import Scratch

#: Kinds in the order of ties: pattern, group of the value, least length of the value.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    # a whole run of 20 or more with a digit and a letter
    "opaque": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}", 0, 20),
}
BASE = ["assign", "access", "hex"]
MAX_OWNERS, MAX_REPOSITORIES = 2, 64
RESULTS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_examples", "live_spans"]
HITS = "array<struct<before:int,size:int,value:string>>"


def hits(text: Column, kind: str) -> Column:
    """The matches of a kind, in order: the characters between it and the one before, its length, and its value if that is long enough."""
    pattern, group, least = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("part"), found.alias("hit"), values.alias("value"))
    each = F.transform(pairs, lambda x: F.struct(F.length(x["part"]).alias("before"), F.length(x["hit"]).alias("size"), F.when(F.length(x["value"]) >= least, x["value"]).alias("value")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast(HITS))


def spans(scanned: DataFrame) -> DataFrame:
    """key, owner, repository, digest, start, kind, end of the hits of ``scanned``; a start is a running sum over what lies before, and an opaque
    run that touches another kind's span is none."""
    rows = scanned.select("key", "owner", "repository", F.posexplode("hits").alias("kind", "of_kind")).where(F.size("of_kind") > 0)
    rows = rows.select("key", "owner", "repository", "kind", F.posexplode("of_kind").alias("place", "x"))
    so_far = Window.partitionBy("key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("x.before") + F.col("x.size")).over(so_far).cast("int")).where("x.value is not null")
    rows = rows.select("key", "owner", "repository", "kind", F.sha2("x.value", 256).alias("digest"), (F.col("end") - F.col("x.size")).alias("start"), "end")
    order, opaque = Window.partitionBy("key").orderBy("start", "kind", "end"), F.col("kind") == list(KINDS).index("opaque")
    before = F.max(F.when(~opaque, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(~opaque, F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("touched", opaque & (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))))
    return rows.where(~F.col("touched")).drop("touched")


def _joined(found: Column, keep) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(F.filter(found, keep)), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _judged(spark: SparkSession, scratch: Scratch, rows: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """``rows`` (key, given, owner, repository, text) as key, given, found: its spans, each with whether it looks live, its owners and
    repositories."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = scratch.keep(rows.select("key", "given", "owner", "repository", F.array(*(hits(text, k) for k in KINDS)).alias("hits")), "scanned")
    each = scratch.keep(spans(scanned), "spans")
    owned = each.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("digest", "owner").agg(F.count("one").alias("n")).groupBy("digest").agg(F.count("n").alias("owners"), F.sum("n").alias("repositories"))
    # written, so that a join of two tables is left in which Spark can split a digest that many rows share
    owned = scratch.keep(owned.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)), "owned")
    judged = each.join(owned, "digest").groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories")).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>")
    return scanned.select("key", "given").join(judged, "key", "left").select("key", "given", F.coalesce("found", none).alias("found"))


def scan_secrets(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """All columns of ``docs`` but text and those named as results, and RESULTS."""
    scratch, opaque = Scratch(spark, "secrets"), list(KINDS).index("opaque")
    given = F.struct(*(c for c in docs.columns if c not in ("text", *RESULTS)))  # in one column, so that no name can clash
    judged = _judged(spark, scratch, docs.select(F.monotonically_increasing_id().alias("key"), given.alias("given"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), "text"), max_owners, max_repositories)
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    result = judged.select(
        "given.*",
        *(count(k) for k in BASE),
        F.sha2(_joined(found, lambda x: x["kind"] != opaque), 256).alias("base_sha256"),
        _joined(found, lambda x: (x["kind"] != opaque) | x["live"]).alias("spans"),
        F.size(F.filter(found, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(found, lambda x: ~x["live"])).cast("long").alias("n_examples"),
        _joined(found, lambda x: x["live"]).alias("live_spans"),
    )
    return scratch.close(result)


def redacted(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` with what looks like a live secret overwritten in the texts, character by character, with ``*``. Only texts with a candidate
    are written out and joined; the others pass as they are."""
    scratch = Scratch(spark, "redacted")
    some = F.coalesce(F.col("text").rlike("|".join(f"(?:{pattern})" for pattern, _, _ in KINDS.values())), F.lit(False))
    rows = scratch.keep(docs.where(some).select(F.struct("*").alias("given"), F.monotonically_increasing_id().alias("key")), "candidates")
    part = lambda c: F.col("given").getField(c)
    judged = _judged(spark, scratch, rows.select("key", F.lit(0).alias("given"), part(owner).alias("owner"), part(repository).alias("repository"), part("text").alias("text")), max_owners, max_repositories)
    live = judged.select("key", F.array_sort(F.filter("found", lambda x: x["live"])).alias("live")).where(F.size("live") > 0)
    text = part("text")

    def cover(s: Column, x: Column) -> Column:
        start, end = F.greatest(x["start"], s["at"]), x["end"]
        more = F.struct(end.alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, start - s["at"]), F.repeat(F.lit("*"), end - start)).alias("out"))
        return F.when(end > s["at"], more).otherwise(s)

    covered = F.aggregate("live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cover, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = rows.join(live, "key", "left").withColumn("text", F.when(F.col("live").isNull(), text).otherwise(covered))
    return changed.select(*((F.col("text") if c == "text" else part(c)).alias(c) for c in docs.columns)).union(docs.where(~some))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return found.drop("source")


def _oracle() -> str:
    """The spans by splitting and extracting as above; RE2 has no look-around, so opaque runs are filtered after the match."""
    patterns = {k: p for k, (p, _, _) in KINDS.items()} | {"opaque": "[A-Za-z0-9+/_-]+"}
    test = {k: f"length(value) >= {n}" for k, (_, _, n) in KINDS.items()}
    test["opaque"] += " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')"
    parts = []
    for i, (k, p) in enumerate(patterns.items()):
        p = p.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, source, {i} AS kind, '{k}' AS name, start, start + length(hit) AS stop, value FROM (
SELECT doc_id, source, hits[i] AS hit, vals[i] AS value, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
SELECT doc_id, source, hits, vals, parts, unnest(range(1, len(hits) + 1)) AS i FROM (
SELECT doc_id, source, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {KINDS[k][1]}) AS vals, string_split_regex(t, '{p}') AS parts FROM texts WHERE regexp_matches(t, '{p}')))) WHERE {test[k]}"""
        )
    return (
        "WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), every AS ("
        + " UNION ALL ".join(parts)
        + f"""), found AS (SELECT * FROM every e WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM every b WHERE b.kind < 3 AND b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
owned AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) <= {MAX_OWNERS} AND count(DISTINCT doc_id) <= {MAX_REPOSITORIES} AS live FROM found GROUP BY value),
judged AS (SELECT f.*, o.live, name || ':' || start || ':' || stop AS label FROM found f JOIN owned o ON f.value = o.value)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
sha256(coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live), '') AS spans,
count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_examples, coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (WHERE live), '') AS live_spans
FROM texts t LEFT JOIN judged j ON t.doc_id = j.doc_id GROUP BY t.doc_id"""
    )


ORACLES = {"op7_secret_scan": _oracle()}

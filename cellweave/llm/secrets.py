"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every historical version of a text is content-addressed by SHA-256; a ledger, kept in a folder, has the spans found per
(blob, rule version). A scan reads only the pairs that the ledger lacks, adds them, and joins findings back to every path
and version that holds the blob.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, whole

#: Kind, pattern, group whose length counts, least length of it, and a pattern that any match contains.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Public token formats beyond the base rules.
MORE_RULES = (
    ("github", r"\bgh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]+", 0, 24, r"xox[abprs]-[A-Za-z0-9-]{19}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\."),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
ALL_RULES = RULES + MORE_RULES
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,byte_start:int,byte_end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPAN}"
#: Elements that a fold appends to before it hands on a block, so that a text's matches take about linear time.
BLOCK = 128


def rule_version(rules: tuple = ALL_RULES) -> str:
    """A digest of the rules, so that changed rules scan every blob again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def fold(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]], join: Callable[[Column], Column]) -> Column:
    """struct(state, out): ``step`` gives each item's next state and the array it adds to the output.

    Appending copies an array, so outputs are appended in blocks of ``BLOCK`` items, each block's put through ``join``
    (which makes one element of it), and blocks are appended to each other.
    """
    none = F.array().cast(f"array<{out}>")

    def inside(acc, block):
        def one(a, x):
            after, added = step(a["state"], x)
            return F.struct(after.alias("state"), F.concat(a["out"], added).alias("out"))

        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(join(d["out"]))).alias("out")))

    def run(whole_items):
        last = F.greatest(F.floor((F.size(whole_items) - 1) / BLOCK), F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole_items, b * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, F.struct(state.alias("state"), F.array(join(none)).alias("out")), inside)

    return let(items, run)


def spans_of(text: Column, rank: int, rule: tuple) -> Column:
    """Leftmost non-overlapping matches of one rule as (start, rank, kind, end) in code points and in bytes, too short
    ones dropped.

    The pieces between matches and the matches themselves, laid end to end, give each match's place.
    """
    kind, pattern, group, least, hint = rule
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def lay(gaps, matches, groups):
        sizes = lambda x, f: F.transform(x, f)
        return F.arrays_zip(F.slice(sizes(gaps, F.length), 1, F.size(matches)).alias("gap"), F.slice(sizes(gaps, F.octet_length), 1, F.size(matches)).alias("byte_gap"), sizes(matches, F.length).alias("len"), sizes(matches, F.octet_length).alias("bytes"), sizes(groups, F.length).alias("n"))

    laid = let(pieces, lambda p: let(found, lambda f: lay(p, f, counted if group else f)))

    def step(at, x):
        start, first = at["at"] + x["gap"], at["byte"] + x["byte_gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end"), first.alias("byte_start"), (first + x["bytes"]).alias("byte_end"))
        return F.struct((start + x["len"]).alias("at"), (first + x["bytes"]).alias("byte")), F.when(x["n"] >= least, F.array(span)).otherwise(F.array().cast(SPAN))

    none = F.array().cast(SPAN)
    walked = F.flatten(fold(laid, F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte")), SPAN[6:-1], step, lambda spans: spans.cast(SPAN))["out"]).cast(SPAN)
    return F.coalesce(F.when(text.rlike(hint), walked).otherwise(none), none)


def find(text: Column, rules: tuple = ALL_RULES) -> Column:
    """All spans of all rules, by start, then by rule."""
    return F.array_sort(F.concat(*(spans_of(text, i, r) for i, r in enumerate(rules))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in a folder of the shared store, empty where nothing was added yet."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/part=*").select("blob", "rule_version", "spans")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = ALL_RULES) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of ``docs`` that ``ledger`` lacks under these rules.

    Blobs without findings get a row too, else they would be scanned again. Copies meet in a map-side combined
    aggregate, so a hot text is shuffled once a task. A null text is an empty one; an empty table gives no rows.
    """
    version = rule_version(rules)
    blobs = docs.select(whole().alias("text")).select(blob_id(F.col("text")).alias("blob"), "text")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    once = blobs.dropDuplicates(["blob"])
    return once.select("blob", F.lit(version).alias("rule_version"), find(F.col("text"), rules).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rules: tuple = ALL_RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, add it there as a part of its own, and return the ledger's new rows.

    A part is written once and appears when complete, so scans side by side only repeat work and a lost executor none.
    """
    spark = docs.sparkSession
    part, known = f"{path}/part={uuid.uuid4().hex}", open_ledger(spark, path)
    scan_unseen(docs, None if known.isEmpty() else known, rules).write.option("compression", "zstd").parquet(part)
    return spark.read.schema(LEDGER).parquet(part)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple = ALL_RULES, carry: list[str] | None = None) -> DataFrame:
    """(row, spans): of each row of ``docs`` the columns ``carry``, else all, and the spans of its text. Only blobs with
    findings are joined, so most rows meet no partner; a blob that several parts of the ledger hold counts once."""
    known = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), blob_id(whole()).alias("blob"))
    return rows.join(known, "blob", "left").select("row", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan_history(versions: DataFrame, path: str, rules: tuple = ALL_RULES) -> DataFrame:
    """(path, version, n_spans, spans) of every historical version (path, version, text) of every path.

    Only blobs that the ledger at ``path`` lacks are scanned, and a blob once, however many paths and versions hold it.
    Null paths or versions and repeated rows keep a row each; a null text is empty; other columns are ignored.
    """
    thin = versions.select("path", "version", "text")
    update_ledger(thin, path, rules)
    rows = findings(thin, open_ledger(versions.sparkSession, path), rules, ["path", "version"])
    return rows.select("row.path", "row.version", F.size("spans").alias("n_spans"), listed(F.col("spans")).alias("spans"))


def session_ledger(spark: SparkSession) -> str:
    """The folder of the ledger: the one that spark.cellweave.secretLedger names, which later runs open again; else a new
    one in the shared folder, so that a run without the setting scans everything."""
    return spark.conf.get("spark.cellweave.secretLedger", None) or f"{shared_dir(spark)}/cellweave/secret-ledger-{uuid.uuid4().hex}"


def secret_report(docs: DataFrame, path: str | None = None, rules: tuple = ALL_RULES) -> DataFrame:
    """Counts and spans per document; see ``op8_secrets``. Blobs that the ledger at ``path`` holds are not scanned.

    A null or empty text has no spans; null or repeated doc_ids keep a row each; extra columns are ignored; an empty table
    gives no rows.
    """
    thin, path = docs.select("doc_id", "text"), path or session_ledger(docs.sparkSession)
    update_ledger(thin, path, rules)
    base = [k for k, *_ in RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    only = F.filter("spans", lambda s: s["kind"].isin(base))
    rows = findings(thin, open_ledger(docs.sparkSession, path), rules, ["doc_id"])
    return rows.select("row.doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(F.encode(listed(only), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mask``; cut by bytes, which needs no walk to a place."""
    joined = lambda parts: F.array_join(parts, "")

    def cut(data):
        part = lambda a, n: F.substring(data, a + 1, n).cast("string")
        step = lambda at, s: (F.greatest(at, s["byte_end"]), F.when(s["byte_start"] >= at, F.array(part(at, s["byte_start"] - at), F.lit(mask))).otherwise(F.array().cast("array<string>")))
        return let(fold(spans, F.lit(0), "string", step, joined), lambda d: F.concat(joined(d["out"]), part(d["state"], F.octet_length(data))))

    return let(F.encode(text, "UTF-8"), cut)


def redact(docs: DataFrame, path: str | None = None, rules: tuple = ALL_RULES) -> DataFrame:
    """``docs`` with secrets masked; rows without findings, null texts among them, are unchanged.

    Repeated rows and null doc_ids keep a row each, other columns are kept whatever their names, an empty table stays
    empty.
    """
    path = path or session_ledger(docs.sparkSession)
    update_ledger(docs, path, rules)
    found = findings(docs, open_ledger(docs.sparkSession, path), rules)
    text = F.when(F.size("spans") > 0, masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _matches_sql(rank: int, rule: tuple) -> str:
    kind, pattern, group, least, hint = rule
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT n, {rank} AS rank, '{kind}' AS kind, i, length(gap) AS gap, length(f) AS len, length(g) >= {least} AS ok FROM (
    SELECT n, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS f, unnest(counted) AS g, unnest(gaps[1:len(found)]) AS gap FROM (
      SELECT n, regexp_extract_all(t, {quoted}) AS found, regexp_extract_all(t, {quoted}, {group}) AS counted, string_split_regex(t, {quoted}) AS gaps FROM docs))"""


_LISTED = "string_agg(kind || ':' || CAST(stop - len AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - len, rank)"
OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({' UNION ALL '.join(_matches_sql(i, r) for i, r in enumerate(ALL_RULES))}),
placed AS (SELECT *, sum(gap + len) OVER (PARTITION BY n, rank ORDER BY i) AS stop FROM matches),
listed AS (SELECT n, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in RULES)},
  {_LISTED} FILTER (WHERE rank < {len(RULES)}) AS base, {_LISTED} AS spans FROM placed WHERE ok GROUP BY n)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN listed USING (n)
"""

"""License scans by canonical digest lookup, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole
from .license_texts import ALL_TEXTS, SPELLINGS

#: Words before which a line that begins with copyright, or an item (c), goes on with a sentence of the licence.
GOES_ON = "notices?|holders?|owners?|laws?|licen[cs]es?|permissions?|statements?|disclaims?|disclaimers?|interests?|treaty|treaties|protections?|infringements?|rights?|and|or|on|in|is|of|to|for|as|if|at|with|that|this|which|such|may|shall|will|are|resulting|doctrines|ownership|the (?:software|library|program)"
ITEM = "under|you|the|to|a|an|any|if|in|it|all|for|this|that|each|every|no|such|use|must|where|when"
_YEAR = r"[\[<{(]?(?:[0-9]{4}|yyyy|year)"
#: Lines that carry a copyright statement, in lower case: a sign, a year or a holder follows. Only a newline ends a line.
COPYRIGHT = rf"(?md)^[\t ]*(?:©|copyright[\t ,:]*(?:\(c\)|©|{_YEAR})|copyright[\t :]+(?!(?:{GOES_ON})\b)[^\s,.;:)]|\(c\)[\t ]*(?:copyright|{_YEAR})|\(c\)[\t ]+(?!(?:{ITEM})\b)[^\s])[^\n]*$"
#: Runs of ASCII other than letters and digits; bytes of other scripts stay.
FILLER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f©]+"
MENTION = r"(?i)licen[cs]e"


def spellings_pattern() -> str:
    return r" (?:" + "|".join(a for a, _ in SPELLINGS) + ") "


def canonical(text: Column) -> Column:
    """Lower case, copyright lines dropped, punctuation and white space one space, equivalent spellings unified."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), FILLER, " "), F.lit(" "))
    same = plain
    for a, b in SPELLINGS:
        same = F.replace(same, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(F.when(plain.rlike(spellings_pattern()), same).otherwise(plain), " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known_digests(spark: SparkSession, texts=ALL_TEXTS) -> DataFrame:
    """(digest, license_id) of the canonical texts; its size is that of a list in the source, so it may be broadcast."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in texts)))
    rows = spark.range(1).select(each.alias("x")).select("x.*")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, texts=ALL_TEXTS) -> DataFrame:
    """(doc_id, digest, license_id, notices): the licence a whole text is, and those that single lines of it are.

    license_id comes of a hash join of the whole text's digest with the known ones, null where none is equal. notices
    looks up each line that mentions a licence, distinct identifiers in order, comma-joined, empty where none. A null
    text is an empty one; an empty text, or one of copyright lines alone, is no licence. Null or repeated doc_ids keep a
    row each; extra columns, whatever their names, are ignored; an empty table gives no rows.
    """
    digests = known_digests(docs.sparkSession, texts).collect()
    table = F.create_map(*(F.lit(x) for r in digests for x in (r["digest"], r["license_id"])))
    known = docs.sparkSession.range(1).select(F.explode(table).alias("digest", "license_id"))
    rows = docs.select("doc_id", whole().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MENTION))
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.transform(lines, digest).alias("_lines"))
    found = F.filter(F.transform("_lines", lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "digest", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _states_copyright_sql(line: str) -> str:
    """``COPYRIGHT`` of one line in lower case, for patterns without look-ahead: a holder is what follows and is no sentence."""
    start = lambda pattern: f"regexp_matches({line}, '^[\\t ]*{pattern}')"
    sign = start(rf"(?:©|copyright[\t ,:]*(?:\(c\)|©|{_YEAR})|\(c\)[\t ]*(?:copyright|{_YEAR}))")
    holder = f"({start(r'copyright[\t :]+[^\s,.;:)]')} AND NOT {start(rf'copyright[\t :]+(?:{GOES_ON})\b')})"
    item = f"({start(r'\(c\)[\t ]+[^\s]')} AND NOT {start(rf'\(c\)[\t ]+(?:{ITEM})\b')})"
    return f"({sign} OR {holder} OR {item})"


def _canonical_sql(text: str) -> str:
    lines = f"array_to_string(list_transform(string_split(lower({text}), chr(10)), lambda x: CASE WHEN {_states_copyright_sql('x')} THEN '' ELSE x END), chr(10))"
    same = f"' ' || regexp_replace({lines}, '{FILLER}', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        same = f"replace({same}, ' {a} ', ' {b} ')"
    return f"sha256(trim(regexp_replace({same}, ' +', ' ', 'g')))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP6_SQL = f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {_canonical_sql('t')} AS digest FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in ALL_TEXTS)}) AS x(license_id, t)) GROUP BY digest),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT n, {_canonical_sql('line')} AS digest FROM (SELECT n, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{MENTION}')),
noted AS (SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN known USING (digest) GROUP BY n)
SELECT doc_id, d.digest, license_id, coalesce(notices, '') AS notices FROM (SELECT *, {_canonical_sql('t')} AS digest FROM docs) d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN noted USING (n)
"""

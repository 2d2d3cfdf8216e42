"""The thin queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table


def _spans(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    found = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans(F.col("base")), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import as_text, fingerprints

    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_key, replace_pii

    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


# What SQL can say of the operators above, from the same rows: the other columns are held against brute force in the tests.


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_source_mix": op4_source_mix,
    "op5_secret_scan": op5_secret_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_fingerprint": op9_fingerprint,
    "op10_pii_surrogates": op10_pii_surrogates,
    "url_rules": url_rules,
    "mix_targets": mix_targets,
    "secret_counts": secret_counts,
    "license_phrases": license_phrases,
    "edited_texts": edited_texts,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WINDOW = "array_to_string(w[i:i + n - 1], ' ')"

_CONTAMINATION_SQL = f"""
WITH items AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
  starts AS (SELECT item, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
  grams AS (SELECT DISTINCT item, n, {_WINDOW} AS g FROM starts),
  docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) AS w FROM documents),
  places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams) sizes WHERE len(w) >= n),
  hits AS (SELECT p.doc_id, p.i, p.n, g.item FROM (SELECT doc_id, i, n, {_WINDOW} AS g FROM places) p JOIN grams g ON p.g = g.g AND p.n = g.n),
  covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) x GROUP BY 1),
  found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS who FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.who, '')) AS items_sha256, coalesce(f.n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

_NEAR_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
  starts AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0),
  shingles AS (SELECT DISTINCT doc_id, {_WINDOW} AS g FROM starts),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id != b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
  comps AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN comps c USING (doc_id)
"""

_RULES_SQL = """
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
  named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
  rules(rule, ruled, domain, start) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
  fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled FROM named JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY 1)
SELECT page_id, host, path, rule, ruled FROM named LEFT JOIN fits USING (page_id)
"""

_TARGETS_SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
  per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
  capped AS (SELECT *, 2.0 * source_size AS cap, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM per),
  levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM capped
    WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  theta AS (SELECT arg_min(level, cap / w) AS theta FROM levels WHERE level * w <= cap)
SELECT doc_id, size, source_size, round(least(cap, coalesce(theta * w, cap))::DOUBLE, 6) AS target FROM sized JOIN levels ON sized.source IS NOT DISTINCT FROM levels.source CROSS JOIN theta
"""

_ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SECRETS_SQL = f"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM documents
"""

_PHRASES_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) AS w FROM documents),
  places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
  hits AS (SELECT doc_id, i - 1 AS i, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM places),
  found AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits WHERE label IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM docs LEFT JOIN found USING (doc_id)
"""

_EDITED_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  pairs AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM docs)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(t, 1, n - n // 3) || substr(after, 1, n // 3)) AS edited_sha256 FROM pairs
"""

#: The others are models, decoders, roundings or own hashes; the tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": _CONTAMINATION_SQL, "op6_near_duplicates": _NEAR_SQL, "url_rules": _RULES_SQL, "mix_targets": _TARGETS_SQL, "secret_counts": _SECRETS_SQL, "license_phrases": _PHRASES_SQL, "edited_texts": _EDITED_SQL,
}

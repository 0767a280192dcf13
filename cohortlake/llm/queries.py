"""The queries over the given tables, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.decontaminate import contamination
from cohortlake.llm.exact import exact_duplicates
from cohortlake.llm.htmltext import extract
from cohortlake.llm.language import identify, learn
from cohortlake.llm.licences import CONTAINMENT, NOTICES, PHRASES, STRIDE, license_scan, needed, template_words
from cohortlake.llm.mixing import mix
from cohortlake.llm.neardup import near_duplicates
from cohortlake.llm.prefixtrie import prefix_trie, turns, with_shared_openings
from cohortlake.llm.runs import periodic_runs
from cohortlake.llm.suffixes import remove_repeats
from cohortlake.llm.tokens import count_tokens
from cohortlake.llm.toxicity import learn as learn_toxicity
from cohortlake.llm.toxicity import score as score_toxicity
from cohortlake.llm.warc import archive
from cohortlake.session import settle


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_read(spark, folder, "documents"), depth=50).drop("starts", "stops")


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(_read(spark, folder, "pages").select("page_id", "url", "html"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix(_read(spark, folder, "documents"), weights=[3, 1, 2], share=1.5, max_epochs=2.0, seed=4)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def _fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    labels = _read(spark, folder, "labels").where(_fold(5) != 0).select("doc_id", "toxic")
    model = learn_toxicity(docs.select("doc_id", "text").join(labels, "doc_id"), order=F.xxhash64("doc_id"))
    return score_toxicity(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    prototypes = learn(docs.where(_fold(3) != 1), order=F.xxhash64("doc_id"))
    return identify(docs, prototypes).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive(_read(spark, folder, "pages"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_read(spark, folder, "documents"), keep="max")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # a machine without its vocabularies can run the other queries

    return count_tokens(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048, drops_space=True)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), size=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    said = settle(turns(_read(spark, folder, "conversations")), "turns")
    return prefix_trie(*with_shared_openings(said, every=20, below=4))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(_read(spark, folder, "documents")).drop("blocks")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs(_read(spark, folder, "documents"), planted=True, digests=True)


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_WARC = """
WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM t WHERE octet_length(encode(h)) >= 100 GROUP BY h)
SELECT page_id, octet_length(encode(t.h)) AS payload_bytes, sha256(t.h) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM t LEFT JOIN g ON t.h = g.h"""

SQL_EXACT = f"""
WITH t AS (SELECT doc_id, {_LOWER.format('text')} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body"""

SQL_MIX = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('4:' || doc_id) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
f AS (
  SELECT *, cap / weight AS fill,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT arg_min(level, fill) FILTER (WHERE level <= fill) AS level FROM f),
g AS (SELECT f.source, source_size, CASE WHEN a.level IS NULL THEN cap ELSE least(cap, a.level * weight) END AS target FROM f, a),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM g),
o AS (
  SELECT doc_id, size, source_size, target, times, rest,
    coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((times + CASE WHEN rest - start > size / 2.0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o"""

SQL_DECONTAMINATE = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT n FROM wins),
cut AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, cut.n, i, item_id FROM cut JOIN wins ON cut.n = wins.n AND cut.s = wins.s),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

_BYTES = "list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT))"
_BITS = "list_prepend(xor(a, b), list_transform(range(8), lambda z: z::UBIGINT))"
_CRC32 = f"xor(list_reduce({_BYTES}, lambda a, b: list_reduce({_BITS}, lambda s, z: xor(s >> 1, (s & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"

SQL_TRIE = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY p) AS s, {_CRC32} % 4 AS h FROM t GROUP BY c),
b AS (SELECT o.c, list_concat(coalesce(z.s[1 : o.h::BIGINT], []), o.s[o.h::BIGINT + 1 :]) AS s FROM o LEFT JOIN o z ON z.c = o.c - o.c % 20),
n AS (SELECT c, d, s[1:d] AS k, d = len(s) AS ended FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
v AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended) AS ends
  FROM n GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
u AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN v.d > 0 THEN (n_convs - 1) * len(regexp_extract_all(v.k[v.d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS gain
  FROM v LEFT JOIN kids ON v.d = kids.d AND v.k = kids.k),
below AS (
  SELECT a AS d, k[1:a] AS k, sum(gain)::BIGINT AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT k, gain, n_children, unnest(range(0, d + 1)) AS a FROM u) GROUP BY ALL)
SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, leaves AS n_leaves,
  saved AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN below ON u.d = below.d AND u.k = below.k LEFT JOIN v p ON p.d = u.d - 1 AND p.k = u.k[1 : u.d - 1]"""

_TEMPLATES = ", ".join(
    f"('{t.label}', {t.phrase}, {needed(t, CONTAINMENT)}, [{', '.join(repr(w) for w in template_words(t))}])" for t in PHRASES + NOTICES
)

SQL_LICENSES = rf"""
WITH t(label, phrase, need, said) AS (VALUES {_TEMPLATES}),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
base AS (SELECT doc_id, label, i - 1 AS p FROM spots, t WHERE phrase AND w[i] = said[1] AND w[i : i + len(said) - 1] = said),
blocks AS (SELECT doc_id, list_distinct(w[{STRIDE} * b + 1 : {STRIDE} * b + {2 * STRIDE}]) AS s
  FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {STRIDE - 1}) // {STRIDE})) AS b FROM docs)),
met AS (SELECT doc_id, label, len(list_intersect(s, said)) / len(list_distinct(said)) AS share FROM blocks, t WHERE NOT phrase AND len(list_intersect(s, said)) >= need),
found AS (SELECT doc_id, label, p, 1.0::DOUBLE AS share FROM base UNION ALL SELECT doc_id, label, NULL, share::DOUBLE FROM met),
named AS (
  SELECT doc_id, count(p) AS n_base, min(p) AS first_word, max(p) AS last_word, max(share) AS score,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE p IS NOT NULL)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs d LEFT JOIN named USING (doc_id)"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_near_duplicates": (op2_near_duplicates, None),
    "op3_html_text": (op3_html_text, None),
    "op4_source_mix": (op4_source_mix, SQL_MIX),
    "op5_toxicity": (op5_toxicity, None),
    "op6_language_id": (op6_language_id, None),
    "op7_warc_archive": (op7_warc_archive, SQL_WARC),
    "op8_exact_dedup": (op8_exact_dedup, SQL_EXACT),
    "op9_token_counts": (op9_token_counts, None),
    "op10_decontamination": (op10_decontamination, SQL_DECONTAMINATE),
    "op11_prefix_trie": (op11_prefix_trie, SQL_TRIE),
    "op12_license_scan": (op12_license_scan, SQL_LICENSES),
    "op13_periodic_runs": (op13_periodic_runs, None),
}

"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import bpe, class_lm, decontaminate, exact_dedup, language_id, license_scan, near_dedup, substring_dedup, token_counts, url_filter
from reelframe.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), url_filter.RULES)


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
, j AS (
  SELECT page_id, host, path,
    (SELECT max_by(h || r.p, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  coalesce((SELECT v FROM r WHERE h || r.p = rule), CASE WHEN host <> '' THEN 'allow' ELSE 'block' END) AS verdict
FROM j
"""

# Words of the word operators, and distinct shingles of five of them (a shorter text is one).
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _shingles_sql(table_name: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM (SELECT {key}, {_WORDS.format(text=_LOWER)} AS w FROM {table_name})"""


OP2_SQL = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}), i AS ({_shingles_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

OP6_SQL = f"""
WITH RECURSIVE s AS ({_shingles_sql("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b),
c AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN f USING (g) WHERE doc_id > first),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p.i) AS kept FROM pos p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is; the same on the driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.held_out_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(table(spark, sf_dir, "documents", "doc_id", "text"), token_counts.standard_edits(), tokenizer_path())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False).drop("kept")


QUERIES = {"op6_near_dedup": op6_near_dedup, "op9_substring_dedup": op9_substring_dedup, "op2_decontaminate": op2_decontaminate, "op4_class_lm": op4_class_lm, "op7_token_counts": op7_token_counts, "op3_bpe": op3_bpe, "op5_license_scan": op5_license_scan, "op8_language_id": op8_language_id} | {"op1_exact_dedup": op1_exact_dedup, "op10_url_filter": op10_url_filter}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op6_near_dedup": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_url_filter": OP10_SQL}

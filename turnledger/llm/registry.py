"""The corpus operators as queries over the given tables, and SQL where it can say them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import (
    bpe,
    class_lm,
    decontamination,
    language,
    line_dedup,
    minhash,
    multi_index,
    ranked_search,
    sharding,
    suffix_dedup,
    token_counts,
    url_filter,
    value_codes,
)

#: The tokenizer file; it has to be at the same place on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, folder, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, folder, "documents"), RANKS, bpe.PATTERN)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return decontamination.digest(found)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP5_SQL = """
WITH doc_lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS p FROM doc_lines
), win AS (
  SELECT doc_id, p, l AS a,
         lead(l, 1) OVER w AS b, lead(l, 2) OVER w AS c
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), placed AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS nth
  FROM win WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p
  FROM placed, (SELECT unnest(range(3)) AS k) WHERE nth > 1
), judged AS (
  SELECT doc_id, p, l, g.p IS NOT NULL AS out
  FROM line LEFT JOIN gone g USING (doc_id, p)
), whole AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed,
         coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT out), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN whole USING (doc_id)
"""


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), TOKENIZER)


def op7_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.scored(table(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fitted(docs.where(language.in_training()))
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        (~language.in_training()).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("lang_spans").cast("long").alias("n_spans"),
        "lang_spans",
    )


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"), n_shards=40)


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), item AS (
  SELECT row_number() OVER () AS i, item_id,
         list_distinct(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
  FROM benchmark
), whole AS (
  SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM doc
), sized AS (
  SELECT r, doc_id, 10 + (90 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM doc, whole WHERE len(ts) > 0
), asked AS (
  SELECT i, unnest(ts) AS t FROM item
), posting AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY r, t
), weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM posting, whole GROUP BY t
), scored AS (
  SELECT i, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN posting USING (t) JOIN weight USING (t) JOIN sized USING (r) GROUP BY i, r, doc_id
), placed AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed JOIN item USING (i) WHERE rank <= 10
"""


def op12_value_codes(spark: SparkSession, folder: str) -> DataFrame:
    return value_codes.compressed(table(spark, folder, "embeddings")).drop("label")


def _op12_round(k: int, last: bool) -> str:
    """Parts put to their nearest entry, and then the entries' means."""
    near = f"""
far{k} AS (
  SELECT v.r, v.p, e.j, list_sum(list_transform(list_zip(v.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part v JOIN book{k} e USING (p)
), near{k} AS (
  SELECT r, p, min(struct_pack(d := d, j := j)) AS best FROM far{k} GROUP BY r, p
)"""
    if last:
        return near
    return near + f""", mean{k} AS (
  SELECT p, j, list(m ORDER BY c) AS x FROM (
    SELECT p, best.j AS j, c, floor(sum(v.x[c])::DOUBLE / count(*))::BIGINT AS m
    FROM near{k} n JOIN part v USING (r, p), range(1, (SELECT any_value(w) FROM wide) + 1) AS place(c)
    GROUP BY p, best.j, c) GROUP BY p, j
), book{k + 1} AS (
  SELECT b.p, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.j = m.j
)"""


#: Means are floored from doubles here: sums and counts are small enough to be exact.
OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), wide AS (
  SELECT max(len(x)) // 4 AS w FROM kept
), part AS (
  SELECT r, p, x[p * w + 1 : (p + 1) * w] AS x FROM kept, wide, range(4) AS parts(p)
), book0 AS (
  SELECT p, r - 1 AS j, x FROM part WHERE r <= 256
), {", ".join(_op12_round(k, k == value_codes.ROUNDS) for k in range(value_codes.ROUNDS + 1))}, coded AS (
  SELECT r, string_agg(printf('%02x', best.j::INTEGER), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM near{value_codes.ROUNDS} GROUP BY r
), book AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{value_codes.ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), book
"""


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH cut AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^#]*)', 1) AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '(?s)^[^?]*') AS plain, regexp_extract(rest, '(?s)\?.*') AS query FROM cut
), named AS (
  SELECT page_id, regexp_extract(plain, '(?s)/.*') AS path, query,
         translate(regexp_extract(plain, '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM split
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, len(rule_host || rule_path)) AS rule_verdict
  FROM named, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rule_verdict
            WHEN regexp_full_match(host || path || query, '(?s)([^/?]*\.)?ads-track\..*|.*/wp-login\.php.*') THEN 'block'
            ELSE 'allow' END AS verdict
FROM named LEFT JOIN fits USING (page_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index": op1_multi_index,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_bpe": op6_bpe,
        "op7_class_lm": op7_class_lm,
        "op8_language": op8_language,
        "op9_sharding": op9_sharding,
        "op10_minhash": op10_minhash,
        "op11_ranked_search": op11_ranked_search,
        "op12_value_codes": op12_value_codes,
        "op13_url_filter": op13_url_filter,
    }


def statements() -> dict[str, str]:
    return {
        "op5_line_dedup": OP5_SQL,
        "op11_ranked_search": OP11_SQL,
        "op12_value_codes": OP12_SQL,
        "op13_url_filter": OP13_SQL,
    }

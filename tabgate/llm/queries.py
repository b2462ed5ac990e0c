"""The queries of the dealt operators, and the SQL that one of them can be told in."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.llm import (
    chat, clusters, decontaminate, extract, language_id, packing, phrases, quality_model, quality_rules, secrets, simhash_dedup,
    suffix_dedup, token_files,
)
from tabgate.llm.tables import table


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = token_files.write_files(table(spark, sf_dir, "documents"), TOKENIZER)
    return token_files.read_files(files, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return verdicts.drop("_id", "_key")


#: The vocabulary file of the queries; it lies in the same place on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_id", "_key")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_windows(turns.unionByName(more), TOKENIZER))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"), length=200)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.3)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, salt="3:")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_windows": op2_chat_windows,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_page_text": op9_page_text,
    "op10_quality_model": op10_quality_model,
    "op11_phrases": op11_phrases,
    "op12_clusters": op12_clusters,
    "op13_secrets": op13_secrets,
}

OP8_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source AS host FROM documents
), w AS (
    SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
    SELECT rid, i, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS gram
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), repeated AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid
), l AS (
    SELECT rid, host, line, len(ws) AS n,
           substr(md5(regexp_replace(translate(list_aggregate(ws, 'string_agg', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g')), 1, 15) AS h
    FROM (SELECT rid, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
          FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d))
    WHERE len(ws) > 0
), doubled AS (
    SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid
), u AS (
    SELECT DISTINCT rid, host, h, n <= 50 AS short FROM l
), low AS (
    SELECT rid, list_sort(list(h)) AS hs FROM u GROUP BY rid
), counted AS (
    SELECT host, h, count(*) AS n,
           count(DISTINCT CASE WHEN len(hs) < 2 THEN '' WHEN h = hs[1] THEN hs[2] ELSE hs[1] END) AS contexts
    FROM u JOIN low USING (rid) WHERE short GROUP BY host, h
), removed AS (
    SELECT c.host, h FROM counted c
    JOIN (SELECT host, count(*) AS n_host FROM d GROUP BY host) s ON s.host IS NOT DISTINCT FROM c.host
    WHERE contexts > 20 AND 2 * contexts >= n AND 1000 * contexts > 2 * n_host
), lost AS (
    SELECT rid, sum(n) AS n FROM l JOIN removed r ON r.h = l.h AND r.host IS NOT DISTINCT FROM l.host GROUP BY rid
), facts AS (
    SELECT doc_id, len(ws) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(doubled.n, 0) AS n_dup_lines,
           coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
    FROM d JOIN w USING (rid) LEFT JOIN doubled USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND NOT 1000 * (n_words - n_removed_words) < 300 * n_words AS kept,
       CAST(n_removed_words AS BIGINT) AS n_removed_words
FROM facts
"""

OP11_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
    FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), g AS (
    SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, ws[i : i + size - 1] AS words
    FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS size))
), f AS MATERIALIZED (
    SELECT lang, size, phrase, any_value(words) AS words, count(*) AS f FROM g GROUP BY lang, size, phrase HAVING count(*) >= 10
), total AS (
    SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang
), cut AS (
    SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r,
           1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1 :], ' ')
), lowest AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
    SELECT DISTINCT s.lang, s.phrase
    FROM (SELECT lang, f, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS phrase
          FROM f WHERE size = 3) o
    JOIN f s ON s.lang = o.lang AND s.phrase = o.phrase WHERE 100 * o.f >= 50 * s.f
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM lowest ANTI JOIN held USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round spelled out: nearest centroids, then floors of means, told from quotients that are cut towards zero."""
    steps = [f"""
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) - 1 AS cluster, x AS c
    FROM x QUALIFY cluster < {k}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, cluster, distance FROM (
        SELECT rid, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM x, c{i})
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM (
            SELECT cluster, place, sum(v) AS s, count(*) AS n
            FROM (SELECT rid, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM x) JOIN a{i} USING (rid) GROUP BY cluster, place)
        GROUP BY cluster) m USING (cluster)
)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda v: CAST(v AS VARCHAR)), ',')) AS centroid_sha256
FROM x JOIN a{rounds} USING (rid) JOIN c{rounds} USING (cluster)
"""


OP13_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), samples AS (
    SELECT sample, false AS random, count(*) AS weight
    FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9+/_-]+')) AS sample FROM d)
    WHERE length(sample) BETWEEN 2 AND 15 GROUP BY sample
    UNION ALL
    SELECT unnest([h, translate(b, '=', ''), upper(translate(b, '+/=', ''))]), true, 1
    FROM (SELECT sha256(CAST(i AS VARCHAR)) AS h, to_base64(unhex(h)) AS b FROM range(4096) t(i))
), steps AS (
    SELECT random, weight, substr(sample, i, 1) AS first, substr(sample, i + 1, 1) AS second
    FROM (SELECT *, unnest(range(1, length(sample))) AS i FROM samples)
), letters AS (
    SELECT unnest(string_split('A B C D E F G H I J K L M N O P Q R S T U V W X Y Z a b c d e f g h i j k l m n o p q r s t u v w x y z'
        || ' 0 1 2 3 4 5 6 7 8 9 + / _ -', ' ')) AS letter
), grid AS (
    SELECT f.letter AS first, s.letter AS second, random FROM letters f, letters s, (VALUES (true), (false)) t(random)
), chances AS (
    SELECT first, second, random, n / sum(n) OVER (PARTITION BY random, first) AS chance
    FROM (SELECT first, second, random, 1 + coalesce(sum(weight), 0) AS n FROM grid LEFT JOIN steps USING (first, second, random)
          GROUP BY ALL)
), ratios AS (
    SELECT a.first, a.second, CAST(floor(1000 * log2(a.chance / (0.95::DOUBLE * b.chance + 0.05::DOUBLE / 66)) + 0.5) AS BIGINT) AS ratio
    FROM chances a JOIN chances b USING (first, second) WHERE a.random AND NOT b.random
), patterns AS (
    SELECT * FROM (VALUES
        (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
        (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'random', '[A-Za-z0-9+/_-]{16,}')) t(kind, name, pattern)
), lists AS (
    SELECT rid, 0 AS kind, regexp_extract_all(text, (SELECT pattern FROM patterns WHERE kind = 0)) AS m,
           regexp_extract_all(text, (SELECT pattern FROM patterns WHERE kind = 0), 2) AS v,
           regexp_split_to_array(text, (SELECT pattern FROM patterns WHERE kind = 0)) AS g FROM d
    UNION ALL
    SELECT rid, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS m, m, regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL
    SELECT rid, 2, regexp_extract_all(text, '[0-9a-f]{16,}') AS m, m, regexp_split_to_array(text, '[0-9a-f]{16,}') FROM d
    UNION ALL
    SELECT rid, 3, regexp_extract_all(text, '[A-Za-z0-9+/_-]{16,}') AS m, m, regexp_split_to_array(text, '[A-Za-z0-9+/_-]{16,}') FROM d
), placed AS (
    SELECT rid, kind, v[i] AS v, i,
           CAST(list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
           s + length(m[i]) AS e
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM lists)
), base AS (
    SELECT rid, kind, s, e, v FROM placed
    WHERE kind = 0 AND length(v) >= 12 OR kind = 1 AND length(v) >= 18 OR kind = 2
), runs AS (
    SELECT rid, s, e FROM (
        SELECT rid, i, s, e, substr(v, k, 1) AS first, substr(v, k + 1, 1) AS second
        FROM (SELECT *, unnest(range(1, length(v))) AS k FROM placed WHERE kind = 3))
    JOIN ratios USING (first, second) GROUP BY rid, i, s, e HAVING sum(ratio) >= 16000
), random AS (
    SELECT rid, 3 AS kind, s, e, '' AS v FROM runs
    ANTI JOIN (SELECT rid, CASE kind WHEN 0 THEN e - length(v) ELSE s END AS s, e FROM base) USING (rid, s, e)
), told AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           count(*) FILTER (kind = 3) AS n_random,
           string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
           string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
    FROM (FROM base UNION ALL FROM random) JOIN patterns USING (kind) GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_random, 0) AS n_random, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""

ORACLE = {"op8_quality_rules": OP8_SQL, "op11_phrases": OP11_SQL, "op12_clusters": clusters_sql(), "op13_secrets": OP13_SQL}

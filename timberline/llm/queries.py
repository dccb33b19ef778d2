"""The operators applied to their whole tables, with the SQL that states the result where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from timberline.llm import (
    byte_bpe, centroid_clustering, chat_format, decontamination, language_id, license_scan, ngram_jaccard, ngram_lm, periodic_runs,
    quality_classifier, quality_rules, token_counts, toxicity,
)
from timberline.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


# The conversation that is put beside those of the table: its texts hold the format's own control strings.
CONTROL_CONVERSATION = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id bigint, turn bigint, role string, text string"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, columns)))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """The query's texts: where crc32(doc_id) ends in 0, the words from a on repeat the p words that start at a."""
    h = F.crc32(F.col("doc_id").cast("string"))
    found = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, found).alias("w"))
    g, n = F.call_function("div", F.col("h"), F.lit(10)), F.size("w")
    placed = listed.select("doc_id", "text", "w", F.when(n > 0, g % n).cast("int").alias("a"), n.alias("n"), (3 + g % 8).alias("times"))
    placed = placed.withColumn("p", (1 + F.call_function("div", F.col("n") - F.col("a"), F.col("times"))).cast("int"))
    again = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_repeats(table(spark, sf_dir, "documents")))
    # The greatest run: longest, then first, then of smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.col3")).alias("period"),
        F.call_function("div", 1000 * F.col("best.length"), -F.col("best.col3")).alias("exponent_milli"),
        F.sha2(digest.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clustering.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)
    digests = [(i, n, ",".join(map(str, c))) for i, (n, c) in enumerate(zip(found.inertia, found.centroids))]  # at most k rows
    of_cluster = spark.createDataFrame(digests, "cluster int, cluster_inertia bigint, components string")
    return found.assigned.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(found.inertia)).cast("bigint").alias("inertia"),
        F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_byte_bpe, op3_ngram_jaccard_join, op4_toxicity, op5_decontamination, op6_quality_classifier,
    op7_license_scan, op8_quality_rules, op9_token_counts, op10_language_id, op11_chat_format, op12_periodic_runs,
    op13_centroid_clustering)} | {"pipeline": corpus_pipeline.run}

# -- SQL --------------------------------------------------------------------------------------

# Control strings of the format with any number of backslashes after the first character; each is given one more.
_CONTROLS = r"'<\\*/?s>|\[\\*/?INST\]'"
_TURN_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_ROLE_LINE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

OP11_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {', '.join(map(repr, CONTROL_CONVERSATION))})
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_TURN_ORDER})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {_TURN_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + len(regexp_extract_all(text, {_CONTROLS})) + CASE WHEN role = 'assistant'
         THEN length('<s>assistant' || chr(10) || '</s>')
         ELSE length('[INST] ' || {_ROLE_LINE} || chr(10) || ' [/INST]') + len(regexp_extract_all({_ROLE_LINE}, {_CONTROLS}))
       END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _quality_sql(deviations: float = 3.0, window: int = 8) -> str:
    """Windows are compared as texts; words hold no blank, so a window's text is its words."""
    rules, scale = quality_rules.RULES, quality_rules.SCALE
    square = float(deviations * deviations)
    sums = ", ".join(f"CAST(sum(CAST({r} AS BIGINT)) AS BIGINT) AS {n}" for n, r in rules.items())
    scaled = {n: f"CAST(floor({scale} * {n} / n) AS BIGINT)" for n in rules}
    moments = ", ".join(f"CAST(sum({x}) AS BIGINT) / count(*) / {scale} AS {n}_mean, CAST(sum({x} * {x}) AS BIGINT) / count(*) / {scale * scale} AS {n}_square"
                        for n, x in scaled.items())
    clipped = ", ".join(f"greatest(least({n}_mean, CAST(0.999 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS {n}_m" for n in rules)
    spread = ", ".join(f"greatest({n}_square - {n}_mean * {n}_mean - {n}_m * (1 - {n}_m) * parts / hosts / 1000000, CAST(1e-9 AS DOUBLE)) AS {n}_v" for n in rules)
    strength = ", ".join(f"greatest(CAST(1 AS DOUBLE), least(CAST(1000 AS DOUBLE), {n}_m * (1 - {n}_m) / {n}_v - 1)) AS {n}_s" for n in rules)
    rates = ", ".join(f"({n} + {n}_m * {n}_s) / (n + {n}_s) AS {n}_rate" for n in rules)
    beyond = " OR ".join(f"({n}_rate > {n}_m AND ({n}_rate - {n}_m) * ({n}_rate - {n}_m) * ({n}_s + 1) > CAST({square} AS DOUBLE) * {n}_m * (1 - {n}_m))" for n in rules)
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT i, p, array_to_string(list_slice(w, p, p + {window - 1}), ' ') AS x FROM docs CROSS JOIN unnest(range(1, len(w) - {window - 2})) u(p)
), again AS (
  SELECT i, p FROM windows QUALIFY count(*) OVER (PARTITION BY i, x) > 1
), covered AS (
  SELECT i, count(DISTINCT p + k) AS n FROM again CROSS JOIN range({window}) r(k) GROUP BY i
), measured AS MATERIALIZED (
  SELECT i, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs) LEFT JOIN covered USING (i)
), hosts AS MATERIALIZED (
  SELECT source, count(*) AS n, {sums} FROM measured GROUP BY source
), moments AS (
  SELECT count(*) AS hosts, CAST(sum(CAST(floor(1000000 / n) AS BIGINT)) AS BIGINT) AS parts, {moments} FROM hosts
), clipped AS (SELECT *, {clipped} FROM moments), spread AS (SELECT *, {spread} FROM clipped
), priors AS (SELECT *, {strength} FROM spread), rates AS (SELECT source, {rates}, * EXCLUDE (source) FROM hosts CROSS JOIN priors
), verdicts AS (SELECT *, {beyond} AS host_rejected FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {rules['short']} OR {rules['repeated']} AS base_failed,
       NOT ({rules['short']} OR {rules['repeated']}) AND NOT host_rejected AS kept, {', '.join(f'{n}_rate' for n in rules)}, host_rejected
FROM measured JOIN verdicts ON measured.source IS NOT DISTINCT FROM verdicts.source
"""


def _clusters_sql(rounds: int = 10, k: int = 8, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain rounds: every vector against every centroid. A key holds the distance first and then the number."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""
, a{r} AS MATERIALIZED (
  SELECT i, min(CAST(list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {k} + c) AS key
  FROM kept CROSS JOIN c{r} GROUP BY i
)""")
        if r < rounds:
            parts.append(f"""
, s{r} AS (
  SELECT CAST(key % {k} AS BIGINT) AS c, p, sum(v[p]) AS s, count(*) AS n
  FROM a{r} JOIN kept USING (i) CROSS JOIN range(1, {dim + 1}) t(p) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r}
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{r} GROUP BY c) m ON m.c = c{r}.c
)""")
    return "".join(parts) + f"""
SELECT vec_id, CAST(a.key % {k} AS INTEGER) AS cluster, CAST(a.key // {k} AS BIGINT) AS distance,
       CAST(sum(a.key // {k}) OVER (PARTITION BY a.key % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.key // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (i) JOIN c{rounds} c ON c.c = a.key % {k}
"""


ORACLES: dict[str, str] = {"op8_quality_rules": _quality_sql().strip(), "op11_chat_format": OP11_SQL.strip(), "op13_centroid_clustering": _clusters_sql().strip()}

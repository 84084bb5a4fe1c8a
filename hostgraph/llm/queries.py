"""The registered queries of this package: name -> (Spark builder, DuckDB SQL or None)."""
from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table as table
from . import (alignment, bpe, fingerprints, lattice, license_scan, packing, periodic_runs, pii, preference, prob_minhash,
               token_output, toxicity, warc)
from .license_templates import PHRASES, TEMPLATES
from .store import drop_table, write_table

LLM: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        LLM[name] = (build, sql)
        return build
    return keep


SQL_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         upper(sha1(coalesce(html, ''))) AS hex
  FROM pages),
b AS (
  SELECT p.*, max(page_id) OVER (PARTITION BY html) AS last,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
             ((strpos('0123456789ABCDEF', substr(hex, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16
              + (strpos('0123456789ABCDEF', substr(hex || '0', CAST(5 * i // 4 + 2 AS INT), 1)) - 1))
             // CAST(pow(2, 3 - (5 * i) % 4) AS INT)) % 32 AS INT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM b
"""


@register("op3_warc_dictionary", SQL_OP3)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    marked = warc.mark_revisits(table(spark, sf, "pages"))
    path = scratch_path(spark, "warc")
    # ids alone, so that no payload goes through the join of the copies for the sample
    stored, stored_path = write_table(marked.where("refers_to IS NULL AND html != ''").select("page_id"), "stored")
    dictionary = warc.train_dictionary(
        table(spark, sf, "pages").withColumn("refers_to", F.lit(None).cast("long")), stored=stored)
    drop_table(spark, stored_path)
    warc.write_archives(marked, path, dictionary)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest",
                                                  "record_type", "refers_to")


@register("op4_token_matrices")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-matrices")
    token_output.write_matrices(token_output.packed_matrices(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    s = token_output.read_sequences(spark, path)
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return s.select("matrix_id", "row", "n_tokens", F.size("doc_id").alias("n_segments"),
                    F.crc32("ids").alias("ids_crc32"), text("cu_seqlens").alias("cu_seqlens"),
                    text("position_resets").alias("position_resets"), text("doc_id").alias("doc_ids"),
                    text("start").alias("starts"))


@register("op8_best_fit_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack_documents(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


SQL_OP1 = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL),
u AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (
  SELECT a.vec_id AS s, b.vec_id AS t FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT s AS vec_id, count(*) AS n_links FROM e GROUP BY s)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@register("op1_lattice_hashing", SQL_OP1)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf, "embeddings"))


@register("op2_bootstrapped_pii")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf, "documents")))


@register("op5_byte_level_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digest(bpe.decode(coded, ranks))


@register("op6_factorization_machine")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return model.score(docs).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


SQL_OP7 = """
WITH t AS (
  SELECT conv_id, list(struct_pack(role := role, body := body) ORDER BY turn, role, body) AS t
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations)
  GROUP BY conv_id),
l AS (
  SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') AS a FROM t),
s AS (
  SELECT *, CASE WHEN len(a) > 0 THEN a[-1] ELSE len(t) END AS k,
         CASE WHEN len(a) > 1 AND t[a[-2]].body <> t[a[-1]].body THEN t[a[-2]].body
              WHEN len(a) > 0 THEN left(t[a[-1]].body, length(t[a[-1]].body) // 2) END AS stale
  FROM l),
f AS (
  SELECT conv_id, t, k, stale, len(a) > 0 AND stale <> t[k].body AS differs,
         replace(t[k].body, '<|im_', '<\\|im_') AS good, replace(stale, '<|im_', '<\\|im_') AS bad,
         list_transform(t, lambda x: '<|im_start|>' || replace(x.role, '<|im_', '<\\|im_') || chr(10)
                                || replace(x.body, '<|im_', '<\\|im_') || '<|im_end|>' || chr(10)) AS lines
  FROM s)
SELECT conv_id AS pair_id, CAST(CASE WHEN differs THEN k - 1 ELSE k END AS INT) AS n_prompt_turns,
       coalesce(array_to_string(lines[1:CASE WHEN differs THEN k - 1 ELSE k END], ''), '') AS prompt,
       CASE WHEN differs THEN '<|im_start|>assistant' || chr(10) || good || '<|im_end|>' || chr(10) ELSE '' END AS chosen,
       CASE WHEN differs THEN '22:' || (32 + length(good)) ELSE '' END AS chosen_mask,
       CASE WHEN differs THEN '<|im_start|>assistant' || chr(10) || bad || '<|im_end|>' || chr(10) ELSE '' END AS rejected,
       CASE WHEN differs THEN '22:' || (32 + length(bad)) ELSE '' END AS rejected_mask
FROM f
"""


@register("op7_preference_pairs", SQL_OP7)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return preference.format_preferences(preference.conversation_pairs(table(spark, sf, "conversations")))


@register("op9_prob_minhash")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "copies", "kept")


@register("op10_one_permutation")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    c = fingerprints.compare_neighbours(table(spark, sf, "documents"))
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return c.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"),
                    "near_edited", "near_next")


@register("op11_lockstep_alignment")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            files.append(f.read())
    return alignment.cross_align(table(spark, sf, "documents"), *files)


def license_sql() -> str:
    """Words by a regular expression, phrases by slices of the word list, templates as regular
    expressions over the words joined by one space."""
    def words(text: str) -> list[str]:
        return re.findall("[a-z0-9]+", text.lower())

    def pattern(template: str) -> str:
        out = ""
        for mark, text in re.findall(r"<<(.*?)>>|((?:(?!<<).)+)", template, re.S):
            if text:
                out += "".join(f" {w}" for w in words(text))
            elif mark.startswith("var;words="):
                out += "(?: [^ ]+){%s}" % mark[10:].replace("..", ",")
            else:
                out += {"beginOptional": "(?:", "endOptional": ")?"}[mark]
        return out + "( |$)"

    hits = ", ".join("list_filter(range(1, len(w) + 1), lambda i: w[i:i + {}] = {}) AS h{}".format(
        len(words(p)) - 1, words(p), n) for n, (_, p) in enumerate(PHRASES))
    every = " || ".join(f"h{n}" for n in range(len(PHRASES)))
    base = ", ".join(f"CASE WHEN len(h{n}) > 0 THEN '{label}' END" for n, (label, _) in enumerate(PHRASES))
    own = ", ".join(f"CASE WHEN regexp_matches(line, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES)
    return rf"""
WITH a AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT *, {hits}, ' ' || array_to_string(w, ' ') AS line FROM a),
c AS (SELECT *, {every} AS h, list_filter([{base}], lambda x: x IS NOT NULL) AS base,
             list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM b)
SELECT doc_id, len(w) AS n_words, len(h) AS n_base, list_min(h) - 1 AS first_word, list_max(h) - 1 AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(base || own)), ','), '') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM c
"""


@register("op12_template_markup", license_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf, "documents"), PHRASES, TEMPLATES))


@register("op13_internal_pattern_matching")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.word_runs(table(spark, sf, "documents"), plant=True))

"""The queries of the training-data operators, each a thin digest of its operator's output, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, langid, lm_score, ngram_join, pii, quality_rules, substring_dedup, token_files
from .common import shared_dir, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base kinds, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS[:4])],
        F.sha2(pii.spell(F.col("base")), 256).alias("base_sha256"),
        pii.spell(F.col("spans")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document under the base rules and the current policy."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = ~quality_rules.passes("base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, expanded and read back."""
    probe = chat_format.END + chat_format.START + "assistant ok"
    extra = spark.sql("SELECT cast(-1 AS bigint) conv_id, cast(id AS bigint) turn, if(id = 0, 'user', 'assistant') role FROM range(2)").withColumn("text", F.lit(probe))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rendered = chat_format.render(turns)
    examples = chat_format.expand(rendered, texts=True)
    reply = chat_format.unescape(F.substring("example", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    loss = (
        examples.select("conv_id", F.struct("target_turn", reply.alias("reply")).alias("r"))
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["reply"]), "").alias("loss"))
        .withColumnRenamed("conv_id", "loss_conv")
    )
    digest = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = rendered.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = whole.join(loss, F.col("conv_id").eqNullSafe(F.col("loss_conv")), "left")
    text = F.coalesce("loss", F.lit(""))
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated windows of 35 words cover."""
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document against all the others."""
    return lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", F.round("mean_log_score", 4).alias("mean_log_score"))


def vocabulary() -> str:
    """The public vocabulary file of the contracts; operators take its path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoding of every document, as digests."""
    return coded(bpe.transcode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()))


def coded(rows: DataFrame) -> DataFrame:
    """The digests of encoded documents."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to shard files and read back."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary())
    back = token_files.read(spark, path)
    return back.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), token_files.crc32("ids").alias("ids_crc32"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item: one row for each such pair."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_SQL2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), pos AS (
  SELECT doc_id, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) AS c FROM pos
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(3) r(k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS n_letters,
         length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

_SQL3 = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(role) + 24) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM a
"""


_SQL4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i + 1:i + 5], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

_SQL5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 35], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM rep, range(35) r(k)
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_chat_format, op4_ngram_join, op5_substring_dedup, op6_lm_score, op7_bpe, op8_token_files, op9_decontaminate, op10_langid)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _SQL2, "op3_chat_format": _SQL3, "op4_ngram_join": _SQL4, "op5_substring_dedup": _SQL5}

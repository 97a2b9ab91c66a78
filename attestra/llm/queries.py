"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.llm import chat_format, collocations, decontaminate, exact_dedup, hard_negatives, line_dedup, packing, pii, quality, repeats, simhash, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=fold != 0)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), F.col("source"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {own}), (-1L, 1L, 'assistant', {own}) AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.conversation_digests(chat_format.format_conversations(turns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_packing, op3_toxicity, op4_token_counts, op5_pii, op6_quality, op7_line_dedup, op8_simhash, op9_chat_format, op10_exact_dedup,
        op11_suffix_dedup, op12_hard_negatives, op13_collocations,
    )
}


def _escaped(text: str) -> str:
    """SQL for a text whose control strings have become codes of two characters, backslashes first."""
    for control in ("\\", "[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>"):
        text = f"replace({text}, '{control}', '{'++' if control == chr(92) else '=='}')"
    return text


ORACLE_SQL = {
    "op7_line_dedup": f"""
        WITH l AS (
          SELECT doc_id, coalesce(source, '') AS host, xs, i, xs[i] AS line, trim(xs[i], ' ') AS t
          FROM (SELECT doc_id, source, xs, unnest(range(1, len(xs) + 1)) AS i
                FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents))),
        totals AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
        bad AS (SELECT host, t, count(DISTINCT doc_id) AS n FROM l WHERE t <> '' GROUP BY host, t),
        flagged AS (SELECT b.host, b.t FROM bad b JOIN totals USING (host) WHERE n >= {line_dedup.PAGES} AND n > total * CAST({line_dedup.RATIO} AS DOUBLE)),
        k AS (SELECT l.*, f.t IS NULL AS stays FROM l LEFT JOIN flagged f ON l.host = f.host AND l.t = f.t),
        joined AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
                     coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS kept FROM k GROUP BY doc_id)
        SELECT doc_id, n_lines, n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM joined""",
    "op9_chat_format": f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
          CAST(sum(length({_escaped('text')}) + 4 + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
                   ELSE 13 + length({_escaped('role')}) END) AS BIGINT) AS formatted_chars,
          regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
                   ORDER BY turn, role, text), 's?(ua)+') AS valid
        FROM t GROUP BY conv_id""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
          sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vec
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF NOT coalesce(isfinite(x), false)]) = 0),
        s AS (
          SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
          FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= 5""",
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]') IF x <> ''] AS ws FROM pieces),
        g AS (
          SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
          FROM (SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size)),
        f AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
        totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
        cuts AS (
          SELECT c.lang, c.phrase, c.a, cut, x.n AS l, y.n AS r, t.n,
            CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
          FROM (SELECT *, unnest(range(1, size)) AS cut FROM c) c
          JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
          JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
          JOIN totals t ON t.lang = c.lang),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_parts AS (
          SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS longer
          FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size > 2))
          GROUP BY ALL)
        SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
        FROM best LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
        WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
}

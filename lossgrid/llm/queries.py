"""The registered queries of the operators, with production parameters.

Each applies its operator to its whole table and derives the columns that its
contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, html, langid, licenses, minhash, mixing, order_minhash, packing, quality, substring, toxicity, whitening
from .util import id_fold, stage, table

#: Scores from here on mean toxic.
TOXIC = 0.7
#: Documents are kept from this probability of good quality on.
GOOD = 0.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "doc_row")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *quality.COUNTS, failed.alias("base_failed"), (~failed & (F.col("quality") >= GOOD)).alias("kept"), "quality")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(stage(sizes, "document-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id (null parts: -), the only tree that the tables name."""
    documents = table(spark, sf_dir, "documents")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("source", "lang", "doc_id")]
    found = licenses.scan(documents.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", *parts).alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.learn(documents, usable=lambda doc_id: id_fold(doc_id, 4) != 2)
    predicted = langid.predict(documents, model)
    return predicted.select("doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"), usable=lambda doc_id: id_fold(doc_id, 3) != 1)
    scored = toxicity.score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that the crc32 of ``conv_id:turn`` deals them, of 20 cases; nulls are one space."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    case, text, role = F.crc32(name.cast("binary")) % 20, F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(case == 1, F.lit("")).when(case == 2, F.translate(text, ".!?", "")).otherwise(text)
    given = rows.where(case != 0).withColumn("_times", F.when(case == 3, 2).otherwise(1))
    given = given.select("conv_id", "turn", F.when(case == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), "_times")
    return given.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("col")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(given)).withColumnRenamed("conv_id", "_of")
    ids = given.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_of")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.against_edits(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_substring": op3_substring,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licenses": op6_licenses,
    "op7_langid": op7_langid,
    "op8_minhash": op8_minhash,
    "op9_toxicity": op9_toxicity,
    "op10_html": op10_html,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_order_minhash": op13_order_minhash,
    "pipeline": pipeline,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS points
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER stay AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = first_value(doc_id) OVER stay AS kept,
               sha256(body) AS text_sha256
        FROM d
        WINDOW stay AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
    """,
    "op8_minhash": """
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ), placed AS (
            SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM worded
        ), runs AS (
            SELECT doc_id, n_words, place, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS shingle
            FROM placed
            WINDOW w AS (PARTITION BY doc_id ORDER BY place)
        ), shingles AS (
            SELECT DISTINCT doc_id, shingle FROM runs WHERE place = 1 OR place <= n_words - 4
        ), sized AS (
            SELECT d.doc_id, count(s.shingle) AS n FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id
        ), measured AS (
            SELECT s.doc_id, s.shingle, z.n FROM shingles s JOIN sized z ON s.doc_id = z.doc_id
        ), edges AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM measured a JOIN measured b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM sized
            UNION
            SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
        )
        SELECT s.doc_id, s.n AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
        FROM sized s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
    """,
    "op11_conversations": """
        WITH RECURSIVE crc AS (
            SELECT list(c ORDER BY i) AS t
            FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
        ), named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
            FROM conversations
        ), cased AS (
            SELECT n.*, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
            FROM named n, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM cased WHERE kind <> 0
        ), placed AS (
            SELECT *, left(role, 1) AS initial,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                   NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut
            FROM damaged
        ), marked AS (
            SELECT *, blank OR again AS forced, CASE WHEN cut THEN 3 ELSE 0 END AS stays,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
            FROM placed
        ), ids AS (
            SELECT DISTINCT conv_id FROM conversations
        ), steps AS (
            SELECT conv_id, 0::BIGINT AS i,
                   {'c': 0::BIGINT, 'a': '', 't': ''} AS s0,
                   {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s1,
                   {'c': 3::BIGINT, 'a': 'I', 't': 'user:' || chr(10)} AS s2,
                   {'c': 6::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s3
            FROM ids
            UNION ALL
            SELECT conv_id, i, n0, n1, m2, least(n3, {'c': m2.c + 3, 'a': m2.a || 'I', 't': m2.t || 'assistant:' || chr(10)})
            FROM (
                SELECT *, least(n2, {'c': n0.c + 3, 'a': n0.a || 'I', 't': n0.t || 'user:' || chr(10)}, {'c': n1.c + 3, 'a': n1.a || 'I', 't': n1.t || 'user:' || chr(10)}, {'c': n3.c + 3, 'a': n3.a || 'I', 't': n3.t || 'user:' || chr(10)}) AS m2
                FROM (
                    SELECT s.conv_id, m.i,
                           {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} AS n0,
                           least({'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + stays + CASE WHEN forced OR initial <> 's' THEN 1000000000 ELSE 0 END, 'a': s0.a || 'K', 't': s0.t || line}) AS n1,
                           least(
                               {'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t},
                               {'c': s0.c + stays + CASE WHEN forced OR initial <> 'u' THEN 1000000000 ELSE 0 END, 'a': s0.a || 'K', 't': s0.t || line},
                               {'c': s1.c + stays + CASE WHEN forced OR initial <> 'u' THEN 1000000000 ELSE 0 END, 'a': s1.a || 'K', 't': s1.t || line},
                               {'c': s3.c + stays + CASE WHEN forced OR initial <> 'u' THEN 1000000000 ELSE 0 END, 'a': s3.a || 'K', 't': s3.t || line},
                               {'c': s0.c + stays + CASE WHEN forced THEN 1000000000 ELSE 3 END, 'a': s0.a || 'R', 't': s0.t || 'user:' || text || chr(10)},
                               {'c': s1.c + stays + CASE WHEN forced THEN 1000000000 ELSE 3 END, 'a': s1.a || 'R', 't': s1.t || 'user:' || text || chr(10)},
                               {'c': s3.c + stays + CASE WHEN forced THEN 1000000000 ELSE 3 END, 'a': s3.a || 'R', 't': s3.t || 'user:' || text || chr(10)}
                           ) AS n2,
                           least(
                               {'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t},
                               {'c': s2.c + stays + CASE WHEN forced OR initial <> 'a' THEN 1000000000 ELSE 0 END, 'a': s2.a || 'K', 't': s2.t || line},
                               {'c': s2.c + stays + CASE WHEN forced THEN 1000000000 ELSE 3 END, 'a': s2.a || 'R', 't': s2.t || 'assistant:' || text || chr(10)}
                           ) AS n3
                    FROM steps s JOIN (SELECT *, role || ':' || text || chr(10) AS line FROM marked) m ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = s.i + 1
                )
            )
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT forced AND cut) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id
        ), solved AS (
            SELECT s.conv_id, s.i, least(s0, s3) AS best FROM steps s
        )
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best.c AS cost, best.a AS audit, sha256(CASE WHEN best.t = '' THEN '' ELSE left(best.t, length(best.t) - 1) END) AS repaired_sha256
        FROM ids d LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
        JOIN solved s ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = coalesce(c.n, 0)
    """,
}

"""The operators of this subpackage over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, langid, lattice_lm, minhash_dedup, paragraph_dedup, preference, quality, toxicity
from .sampling import remainder

_UPPER, _LOWER = exact_dedup.UPPER, exact_dedup.LOWER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn_from=remainder("doc_id", 3) != 1)
    return quality.score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preference.conversations(table(spark, sf_dir, "conversations"))
    sources = {"opening": preference.same_opening(convs), "borrowed": preference.borrowed_reply(convs)}
    pairs = [p.select("chosen_id", "chosen", "rejected_id", "rejected", F.lit(kind).alias("kind")) for kind, p in sources.items()]
    pairs = preference.format_pairs(pairs[0].unionAll(pairs[1]))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return pairs.select("kind", "chosen_id", "rejected_id", "n_prefix", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn_from=remainder("doc_id", 5) != 0)
    return langid.predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=remainder("doc_id", 4) != 2)
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lattice_lm.read_pieces(tokenizer_path("piece_bpe_32k.model"))
    scored = lattice_lm.score(table(spark, sf_dir, "documents"), pieces, learn_from=remainder("doc_id", 10) != 0)
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"), shortest=paragraph_dedup.WIDTH)


QUERIES = {"op1_quality": op1_quality, "op2_preference": op2_preference, "op5_langid": op5_langid, "op3_bpe": op3_bpe, "op4_decontaminate": op4_decontaminate, "op6_toxicity": op6_toxicity, "op7_lm_score": op7_lm_score, "op8_exact_dedup": op8_exact_dedup, "op9_minhash_dedup": op9_minhash_dedup, "op10_paragraph_dedup": op10_paragraph_dedup}

ORACLE_SQL = {
    "op2_preference": """
        WITH t AS (
            SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        anchors AS (SELECT role, text, min(conv_id) AS chosen_id FROM t WHERE i = 0 GROUP BY role, text HAVING count(*) > 1),
        sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
        pair AS (
            SELECT 'opening' AS kind, a.chosen_id, t.conv_id AS rejected_id FROM t JOIN anchors a ON t.i = 0 AND a.role = t.role AND a.text = t.text WHERE t.conv_id <> a.chosen_id
            UNION ALL SELECT 'borrowed', a.conv_id, b.conv_id FROM sizes a JOIN sizes b ON b.conv_id = a.conv_id + 1),
        other AS (
            SELECT p.*, t.i, t.role, t.text FROM pair p JOIN t ON t.conv_id = p.rejected_id WHERE kind = 'opening'
            UNION ALL
            SELECT p.*, t.i, t.role, CASE WHEN t.i = a.n - 1 THEN u.text ELSE t.text END
            FROM pair p JOIN sizes a ON a.conv_id = p.chosen_id JOIN sizes b ON b.conv_id = p.rejected_id JOIN t ON t.conv_id = p.chosen_id JOIN t u ON u.conv_id = p.rejected_id AND u.i = b.n - 1
            WHERE kind = 'borrowed'),
        same AS (
            SELECT o.kind, o.chosen_id, o.rejected_id, count(*) AS n_both, min(CASE WHEN x.role <> o.role OR x.text <> o.text THEN x.i END) AS i
            FROM other o JOIN t x ON x.conv_id = o.chosen_id AND x.i = o.i GROUP BY ALL),
        cut AS (SELECT kind, chosen_id, rejected_id, coalesce(i, n_both) AS n_prefix FROM same),
        sides AS (
            SELECT c.*, 'chosen' AS side, t.i, t.role, '<|' || t.role || '|>' || chr(10) AS head, t.text || '<|end|>' || chr(10) AS body FROM cut c JOIN t ON t.conv_id = c.chosen_id
            UNION ALL SELECT c.*, 'rejected', o.i, o.role, '<|' || o.role || '|>' || chr(10), o.text || '<|end|>' || chr(10) FROM cut c JOIN other o USING (kind, chosen_id, rejected_id)),
        placed AS (
            SELECT *, sum(CASE WHEN i >= n_prefix THEN length(head) + length(body) ELSE 0 END) OVER (PARTITION BY kind, chosen_id, rejected_id, side ORDER BY i) AS e FROM sides),
        joined AS (
            SELECT kind, chosen_id, rejected_id, n_prefix, side, coalesce(string_agg(head || body, '' ORDER BY i) FILTER (i < n_prefix), '') AS prompt,
                   coalesce(string_agg(head || body, '' ORDER BY i) FILTER (i >= n_prefix), '') AS rest,
                   coalesce(string_agg((e - length(body)) || '-' || e, ',' ORDER BY i) FILTER (i >= n_prefix AND role = 'assistant'), '') AS spans
            FROM placed GROUP BY ALL)
        SELECT c.kind, c.chosen_id, c.rejected_id, c.n_prefix, c.prompt, c.rest AS chosen, r.rest AS rejected, c.spans AS chosen_mask, r.spans AS rejected_mask
        FROM joined c JOIN joined r ON r.kind = c.kind AND r.chosen_id = c.chosen_id AND r.rejected_id = c.rejected_id AND c.side = 'chosen' AND r.side = 'rejected'""",
    "op4_decontaminate": f"""
        WITH t AS (
            SELECT 'd' AS k, CAST(doc_id AS VARCHAR) AS id, text FROM documents
            UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), text FROM benchmark),
        w AS (
            SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
            FROM t),
        win AS (
            SELECT DISTINCT id AS item, l, unnest([array_to_string(ws[i:i + l - 1], ' ') for i in range(1, len(ws) - l + 2)]) AS s
            FROM (SELECT id, ws, least(len(ws), 10) AS l FROM w WHERE k = 'i' AND len(ws) > 0)),
        sizes AS (SELECT DISTINCT l FROM win),
        runs AS (
            SELECT id, l, unnest(range(1, len(ws) - l + 2)) AS i, unnest([array_to_string(ws[i:i + l - 1], ' ') for i in range(1, len(ws) - l + 2)]) AS s
            FROM w, sizes WHERE k = 'd' AND len(ws) >= l),
        hits AS (SELECT r.id, r.i, r.l, v.item FROM runs r JOIN win v ON r.l = v.l AND r.s = v.s),
        spots AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY id),
        found AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY id)
        SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(s.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
               sha256(coalesce(f.items, '')) AS items_sha256, s.n_hit IS NOT NULL AS contaminated
        FROM documents d JOIN w ON w.k = 'd' AND w.id = CAST(d.doc_id AS VARCHAR) LEFT JOIN spots s ON s.id = w.id LEFT JOIN found f ON f.id = w.id""",
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op9_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
        reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT l.y, r.r FROM reach r JOIN links l ON l.x = r.doc_id)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept
        FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)""",
}

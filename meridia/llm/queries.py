"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what labels call good, without the held-out fold. A filter keeps most other texts out of the join.

    Labels with a null doc_id or quality are of no document; repeated labels count once, and all rows of a doc_id are of the target.
    """
    from pyspark.sql import functions as F

    from .common import fold
    from .exact_dedup import Suspects
    from .labelled import HELD_OUT
    from .lm_score import cross_entropy_difference

    documents = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (fold(F.col("doc_id")) != HELD_OUT)).select(doc_id)
    likely, _ = Suspects(good.select(F.xxhash64("doc_id").alias("fp"))).among(documents.select(doc_id, "text"), F.xxhash64("doc_id"))
    return cross_entropy_difference(documents, likely.join(good, "doc_id", "left_semi"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import groups

    return groups(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


_OPERATORS = (
    op1_toxicity, op2_neighbours, op3_lm_scoring, op4_exact_dedup, op5_token_files, op6_mixing, op7_token_counts,
    op8_near_dedup, op9_quality, op10_packing, op11_page_text, op12_fill_middle, op13_conversations,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, md5(coalesce(text, '')) AS text_hash,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
          SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
                 ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight
          FROM s),
        l AS (
          SELECT *, cap / weight AS r,
                 ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w),
        t AS (
          SELECT source, source_size,
                 least(cap, weight * (SELECT level FROM l WHERE level * weight <= cap ORDER BY r, source LIMIT 1)) AS target
          FROM l),
        q AS (
          SELECT d.doc_id, d.text_hash, CAST(d.size AS BIGINT) AS size, t.target, turn,
                 CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, md5(concat_ws(':', d.doc_id, turn, d.text_hash)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ended
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS u(turn)
          WHERE d.size > 0),
        l2 AS (
          SELECT *, ended - size AS start,
                 CASE WHEN ended > target AND ended - size < target THEN CAST(ceil(size / 65536) AS BIGINT) ELSE size END AS length
          FROM q),
        p AS (
          SELECT *, unnest(range(1, CAST(ceil(size / length) AS BIGINT) + 1)) AS packet FROM l2),
        e AS (
          SELECT doc_id, text_hash, target, turn, least(start + packet * length, ended) AS last, least(length, ended - start - (packet - 1) * length) AS words
          FROM p),
        r AS (
          SELECT *, last / target AS finish, sum(words) OVER (ORDER BY last / target, doc_id, turn, last ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
          FROM e),
        c AS (
          SELECT doc_id, text_hash, finish, least(words, (SELECT floor(1.5 * sum(source_size)) FROM s) - (run - words)) AS served FROM r),
        k AS (
          SELECT doc_id, text_hash, sum(served) AS taken, min(finish) AS first_finish FROM c WHERE served > 0 GROUP BY doc_id, text_hash)
        SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, k.first_finish
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.doc_id = d.doc_id AND k.text_hash = d.text_hash""",
    "op12_fill_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                 sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
          FROM documents),
        g AS (SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT) FOR k IN range(4)] AS h FROM d),
        f AS (
          SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM g),
        c AS (
          SELECT doc_id, t, n, form, array_to_string(u[: low], '') AS p, array_to_string(u[low + 1 : high], '') AS m, array_to_string(u[high + 1 :], '') AS s
          FROM f)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c""",
    "op13_conversations": r"""
        WITH RECURSIVE k AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
          FROM conversations),
        crc AS (
          SELECT *, xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(place, '')]),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda e, i: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)),
                 4294967295) % 20 AS kind
          FROM k),
        d AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM crc, (VALUES (1), (2)) AS v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
        s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
        o AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i,
                 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words
          FROM s),
        f AS (
          SELECT *, coalesce(conv_id, -1) AS conv, role[1] AS initial,
                 CASE WHEN words = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(words, '[.!?]$') THEN 'truncated' ELSE '' END AS fault
          FROM o),
        g(state, initial, next, name) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
        ins AS (
          SELECT state, state AS next, '' AS edits, []::VARCHAR[] AS added, 0 AS cost FROM (VALUES (0), (1), (2), (3)) AS q(state)
          UNION ALL SELECT state, next, 'I', [name || ':'], 5 FROM g WHERE name IS NOT NULL
          UNION ALL SELECT a.state, b.next, 'II', [a.name || ':', b.name || ':'], 10 FROM g AS a JOIN g AS b ON b.state = a.next WHERE a.name IS NOT NULL),
        e AS (
          SELECT conv, i, q.state, q.state AS next, 'D' AS edit, []::VARCHAR[] AS line, 2 AS cost FROM f, (VALUES (0), (1), (2), (3)) AS q(state)
          UNION ALL
          SELECT conv, i, state, next, 'K', [role || ':' || text], CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END
          FROM f JOIN g ON f.initial = g.initial WHERE fault NOT IN ('blank', 'duplicate')
          UNION ALL
          SELECT conv, i, state, next, 'R', [name || ':' || text], CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END
          FROM f JOIN g ON g.name IS NOT NULL WHERE fault NOT IN ('blank', 'duplicate')),
        t AS (
          SELECT conv, i, e.state, ins.next, e.edit || ins.edits AS edit, list_concat(e.line, ins.added) AS line, e.cost + ins.cost AS cost
          FROM e JOIN ins ON ins.state = e.next),
        w AS (
          SELECT c.conv, CAST(0 AS BIGINT) AS i, next AS state, CAST(cost AS BIGINT) AS cost, edits AS audit, added AS lines
          FROM (SELECT DISTINCT coalesce(conv_id, -1) AS conv FROM conversations) AS c, (SELECT * FROM ins WHERE state = 0) AS first
          UNION ALL
          SELECT conv, i, state, best.cost, best.audit, best.lines
          FROM (
            SELECT w.conv, t.i, t.next AS state, min({'cost': w.cost + t.cost, 'audit': w.audit || t.edit, 'lines': list_concat(w.lines, t.line)}) AS best
            FROM w JOIN t ON t.conv = w.conv AND t.i = w.i + 1 AND t.state = w.state
            GROUP BY w.conv, t.i, t.next) AS layer),
        n AS (
          SELECT conv, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM f) AS p GROUP BY conv),
        z AS (
          SELECT w.conv, min({'cost': w.cost, 'audit': w.audit, 'lines': w.lines}) AS best
          FROM w LEFT JOIN n ON n.conv = w.conv WHERE w.i = coalesce(n.n, 0) AND w.state IN (0, 3) GROUP BY w.conv)
        SELECT CASE WHEN z.conv >= 0 THEN z.conv END AS conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank,
               coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
               z.best.cost AS cost, z.best.audit AS audit, sha256(array_to_string(z.best.lines, chr(10))) AS repaired_sha256
        FROM z LEFT JOIN n ON n.conv = z.conv""",
}

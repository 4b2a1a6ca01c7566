"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversations, exact_dedup, filter_audit, fingerprints, html_extract, languages, near_dedup, packing, secrets, sharding, source_mix, token_counts
from .common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op3_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.report(read_table(spark, sf_dir, "documents"))


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read_table(spark, sf_dir, "documents")).drop("x")


def op6_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(read_table(spark, sf_dir, "documents"))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read_table(spark, sf_dir, "documents"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(read_table(spark, sf_dir, "conversations"))


def op13_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.shares(read_table(spark, sf_dir, "documents"))


#: The pipeline at the repository's top belongs to this package.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run} | {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_counts,
        op3_output_codes,
        op4_grace_dedup,
        op5_order_minhash,
        op6_tree_model,
        op7_byte_bpe,
        op8_scaled_sketch,
        op9_markov_secrets,
        op10_bounded_ring,
        op11_filter_audit,
        op12_conversation_repair,
        op13_pareto_mix,
    )
}

ORACLES: dict[str, str] = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
    "op4_grace_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS (
            SELECT doc_id, part, [
                len(words) < 100,
                100 * len(list_distinct(words)) < 80 * len(words),
                100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
                regexp_matches(t, '[#$%&*|]'),
                coalesce(doc_id > first, false)] AS fails
            FROM w),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        n AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
        x(i) AS (VALUES (1), (2), (3), (4), (5)),
        o AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS places FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (
            SELECT n.*, places, x.i AS step, fails[places[x.i]] AS hit,
                   len(list_filter(places[1:x.i - 1], lambda p: fails[p])) > 0 AS gone,
                   len(list_filter(fails, lambda y: y)) AS many
            FROM n, o, x),
        r AS (
            SELECT part, places, step, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
                   coalesce(sum(n) FILTER (hit AND many = 1), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
            FROM s GROUP BY part, places, step)
        SELECT part, array_to_string(list_transform(places, lambda p: substr('ABCDE', p, 1)), '') AS filter_order, step::INT AS step,
               kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, places[step]))::BIGINT AS shapley
        FROM r
    """,
    # crc32 bit by bit: a byte is xored in, then eight steps (-1) shift
    "op12_conversation_repair": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
            FROM conversations),
        k AS (
            SELECT *, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1),
                    lambda i: [ord(substr(name, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) % 20 AS kind
            FROM c),
        d AS (
            SELECT conv_id, turn, again, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body
            FROM k, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(again)),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, again) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, body ORDER BY turn NULLS FIRST, again) AS nth,
                   rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM d),
        r AS (
            SELECT conv_id, turn, i, role, body, left(role, 1) AS ini,
                   CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM o),
        every AS (SELECT DISTINCT conv_id FROM conversations),
        -- states: 0 nothing yet, s after a system row, u an answer is due, p whole turns
        move(state, ini, following) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'p'), ('p', 'u', 'u')),
        more(state, via, price, letters, lines) AS (VALUES
            ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('p', 'p', 0, '', []),
            ('0', 'u', 3, 'I', ['user:']), ('0', 'p', 6, 'II', ['user:', 'assistant:']), ('s', 'u', 3, 'I', ['user:']),
            ('s', 'p', 6, 'II', ['user:', 'assistant:']), ('u', 'p', 3, 'I', ['assistant:']), ('p', 'u', 3, 'I', ['user:'])),
        way AS (
            SELECT conv_id, i, 'D' AS letter, 4 AS price, NULL AS ini, NULL AS line FROM r
            UNION ALL SELECT conv_id, i, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, ini, role || ':' || body FROM r WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT conv_id, i, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, left(v, 1), v || ':' || body
            FROM r, (VALUES ('user'), ('assistant')) AS t(v) WHERE fault NOT IN ('blank', 'duplicate')),
        dp AS (
            SELECT conv_id, 0::BIGINT AS i, '0' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM every
            UNION ALL
            SELECT dp.conv_id, way.i, coalesce(move.following, more.via) AS state, dp.cost + more.price + way.price AS cost,
                   dp.audit || more.letters || way.letter AS audit,
                   list_concat(list_concat(dp.lines, more.lines), CASE WHEN line IS NULL THEN [] ELSE [line] END) AS lines
            FROM dp JOIN more USING (state) JOIN way ON way.conv_id IS NOT DISTINCT FROM dp.conv_id AND way.i = dp.i + 1
            LEFT JOIN move ON move.state = more.via AND move.ini = way.ini
            WHERE way.letter = 'D' OR move.following IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY dp.conv_id, coalesce(move.following, more.via)
                ORDER BY dp.cost + more.price + way.price, dp.audit || more.letters || way.letter) = 1),
        facts AS (
            SELECT e.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated
            FROM every e LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY e.conv_id),
        pairs AS (
            SELECT conv_id, count(*) FILTER (b || ini NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT conv_id, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM r) GROUP BY conv_id),
        ends AS (
            SELECT dp.conv_id, dp.cost + more.price AS cost, dp.audit || more.letters AS audit, list_concat(dp.lines, more.lines) AS lines
            FROM dp JOIN more USING (state) JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id AND facts.n = dp.i
            WHERE more.via IN ('0', 'p')
            QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + more.price, dp.audit || more.letters) = 1)
        SELECT f.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
               sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM facts f JOIN ends ON f.conv_id IS NOT DISTINCT FROM ends.conv_id LEFT JOIN pairs ON f.conv_id IS NOT DISTINCT FROM pairs.conv_id
    """,
    "op13_pareto_mix": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, source AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
            FROM documents),
        z AS (
            SELECT s, source_size, CASE (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s)),
        -- sources by the level at which they are full: the level is right where the next isn't full
        full_ AS (
            SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, s NULLS LAST) AS k, coalesce(sum(3 * source_size) OVER before, 0) AS held, sum(weight) OVER rest AS open_, sum(source_size) OVER () AS total
            FROM z WINDOW before AS (ORDER BY 3 * source_size / weight, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                          rest AS (ORDER BY 3 * source_size / weight, s NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        level_ AS (
            SELECT coalesce(arg_min((total - held)::DOUBLE / open_, k) FILTER ((total - held)::DOUBLE / open_ * weight <= 3 * source_size), 0) AS level FROM full_),
        t AS (SELECT s, source_size, least(3.0::DOUBLE * source_size, level * weight) AS target FROM z, level_),
        e AS (
            SELECT d.*, source_size, target, least(coalesce(target / nullif(source_size, 0)::DOUBLE, 0), 3.0::DOUBLE) AS expected,
                   (list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 14), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1)), lambda a, b: a * 16 + b) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
                   list_reduce(list_prepend(0::BIGINT, list_transform(range(14, 27), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1)), lambda a, b: a * 16 + b) >> 2 AS v
            FROM d JOIN t ON d.s IS NOT DISTINCT FROM t.s),
        c AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS chance, u / (1 - u) / ((expected - floor(expected)) / nullif(1 - (expected - floor(expected)), 0)) AS odds FROM e),
        p AS (SELECT *, CASE WHEN chance > 0 THEN least(floor(odds / (1 + odds) * 1125899906842624::DOUBLE)::BIGINT, 1125899906842623) END AS place FROM c),
        n AS (SELECT s, first(target) - sum(whole * size)::DOUBLE AS need FROM p GROUP BY s),
        q AS (
            SELECT p.r, p.s, p.size, need, row_number() OVER w AS pos, (sum(size) OVER (PARTITION BY p.s ORDER BY place, v, r ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
            FROM p JOIN n ON p.s IS NOT DISTINCT FROM n.s WHERE place IS NOT NULL WINDOW w AS (PARTITION BY p.s ORDER BY place, v, r)),
        x AS (SELECT s, min(pos) AS cross_, arg_min(need - upto + size, pos) AS gap FROM q WHERE upto > need GROUP BY s),
        f AS (
            SELECT q.s, q.pos, q.size FROM q JOIN x ON q.s IS NOT DISTINCT FROM x.s WHERE pos >= cross_ AND size > 0 AND size <= gap
            QUALIFY row_number() OVER (PARTITION BY q.s ORDER BY pos) <= 1000),
        g AS (
            SELECT s, cross_ - 1 AS pos, gap AS rest FROM x
            UNION ALL
            SELECT f.s, min(f.pos), arg_min(g.rest - f.size, f.pos) FROM g JOIN f ON f.s IS NOT DISTINCT FROM g.s AND f.pos > g.pos AND f.size <= g.rest GROUP BY f.s),
        taken AS (SELECT g.s, g.pos FROM g JOIN x ON g.s IS NOT DISTINCT FROM x.s WHERE g.pos >= cross_),
        l AS (SELECT s, min(rest) AS rest FROM g GROUP BY s),
        b AS (
            SELECT q.s, arg_min(q.pos, (q.size, q.pos)) AS pos
            FROM q JOIN x ON q.s IS NOT DISTINCT FROM x.s JOIN l ON q.s IS NOT DISTINCT FROM l.s
            WHERE q.pos >= cross_ AND q.size > rest AND q.size - rest < rest
              AND NOT EXISTS (SELECT 1 FROM taken WHERE taken.s IS NOT DISTINCT FROM q.s AND taken.pos = q.pos)
            GROUP BY q.s),
        sel AS (
            SELECT q.r FROM q LEFT JOIN x ON q.s IS NOT DISTINCT FROM x.s WHERE cross_ IS NULL OR pos < cross_
            UNION ALL SELECT q.r FROM q JOIN (SELECT * FROM taken UNION ALL SELECT * FROM b) m ON q.s IS NOT DISTINCT FROM m.s AND q.pos = m.pos)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + (p.r IN (SELECT r FROM sel))::INT))::BIGINT AS taken FROM p
    """,
}

"""The numbered operators over whole tables, with their SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.registered import Query, register
from . import hashing, infilling, language, mixing, packing, pivots, privacy, quotations, repair, secret_scan, severity, simhash, url_filters
from .common import table

QUERIES: dict[str, Query] = {}


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register(QUERIES)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(table(spark, sf_dir, "documents"))


@register(QUERIES)
def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


@register(QUERIES)
def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register(
    QUERIES,
    """WITH v AS (
        SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
        FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) WHERE n <= 20""",
)
def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"))


@register(QUERIES)
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    learned = language.prototypes(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return language.identify(docs.drop("lang"), learned).drop("text")


@register(
    QUERIES,
    r"""WITH RECURSIVE m AS (
        SELECT conv_id * 1048576 + turn AS id, conv_id, turn, coalesce(text, '') AS text FROM conversations
    ), wholes AS (
        SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS whole FROM m
    ), passages AS (
        SELECT DISTINCT id, conv_id, turn, p FROM (
            SELECT id, conv_id, turn, whole AS p FROM wholes WHERE whole <> ''
            UNION ALL SELECT * FROM (SELECT id, conv_id, turn, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) AS p FROM m) WHERE length(p) >= 12)
    ), wrote AS (
        SELECT p.id, p.p, coalesce(nullif(a.whole, ''), nullif(b.whole, '')) AS beyond FROM passages p
        LEFT JOIN wholes a ON a.conv_id = p.conv_id AND a.turn = p.turn - 1 LEFT JOIN wholes b ON b.conv_id = p.conv_id AND b.turn = p.turn - 2
    ), quoted AS (
        SELECT m.id, v.level, q.p, b.whole AS beyond FROM m CROSS JOIN (VALUES (1), (2)) v(level)
        JOIN passages q ON q.conv_id = m.conv_id AND q.turn = m.turn - v.level LEFT JOIN wholes b ON v.level = 1 AND b.conv_id = m.conv_id AND b.turn = m.turn - 2
    ), found AS (
        SELECT q.id, q.level, q.p, 0 AS agree, max(w.id) AS parent FROM quoted q JOIN wrote w ON w.p = q.p AND w.id < q.id GROUP BY ALL
        UNION ALL
        SELECT q.id, q.level, q.p, 1, max(w.id) FROM quoted q JOIN wrote w ON w.p = q.p AND w.beyond = q.beyond AND w.id < q.id WHERE q.beyond <> '' GROUP BY ALL
    ), best AS (
        SELECT id, level, parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level, length(p) DESC, agree DESC, parent DESC) AS n FROM found) WHERE n = 1
    ), chain AS (
        SELECT id, id AS root, 0 AS depth FROM m WHERE id NOT IN (SELECT id FROM best)
        UNION ALL SELECT b.id, c.root, c.depth + 1 FROM best b JOIN chain c ON b.parent = c.id
    )
    SELECT m.id AS message_id, c.root AS conversation_id, CAST(c.depth AS INTEGER) AS depth, b.parent AS parent_id,
           CAST(b.level AS INTEGER) AS quote_level, trim(m.text) AS own_text
    FROM m JOIN chain c ON c.id = m.id LEFT JOIN best b ON b.id = m.id""",
)
def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(quotations.as_quoting_mail(table(spark, sf_dir, "conversations")))


@register(QUERIES)
def op7_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from labels: 0 not toxic, 1 toxic, 2 toxic and of low quality; a quarter of the ids is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL")
    graded = labels.select("doc_id", (F.col("toxic") * (2 - F.coalesce("quality", F.lit(1)))).alias("grade"))
    model = severity.learn(docs.where("NOT held_out"), graded, 3)
    found = severity.score(docs, model).drop("text")
    return found.withColumn("toxic", F.col("p_toxic") >= 0.5)


@register(QUERIES)
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.surrogated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


@register(QUERIES)
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizer())


@register(QUERIES)
def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.search(table(spark, sf_dir, "embeddings"))


@register(
    QUERIES,
    r"""WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), u AS (
        SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d
    ), c AS (
        SELECT *, len(l) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM u
    ), p AS (
        SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:n], '') AS suffix FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p""",
)
def op11_wavelet_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut between lines; all are transformed, half of them with the suffix first."""
    made = infilling.infilled(table(spark, sf_dir, "documents"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


# The rules, and what the names of listed hosts contain.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_WORDS = "casino|pills|spam"


@register(
    QUERIES,
    rf"""WITH r AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), u AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r
    ), rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}
    ), listed AS (
        SELECT DISTINCT host FROM u WHERE regexp_matches(host, '{LISTED_WORDS}')
    ), below AS (
        SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM u) h JOIN listed l ON h.host = l.host OR ends_with(h.host, '.' || l.host)
    ), ranked AS (
        SELECT u.*, f.rule_host || f.rule_path AS rule, f.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(f.rule_host || f.rule_path) DESC) AS n
        FROM u LEFT JOIN rules f ON (u.host = f.rule_host OR ends_with(u.host, '.' || f.rule_host)) AND starts_with(u.path, f.rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM below) THEN 'block' ELSE 'allow' END) AS verdict FROM ranked WHERE n = 1""",
)
def op12_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under four rules, and a list of all hosts of the table whose names hold some words."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = url_filters.parts()
    blocklist = pages.select(host.alias("host")).distinct().where(F.col("host").rlike(LISTED_WORDS))
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    return url_filters.judged(pages, rules, blocklist)


# Damage to a row, by a hash of its conversation and turn.
DROPPED, EMPTIED, CUT, REPEATED, CAST = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``repair.ordered`` with a twentieth of them dropped, emptied, without sentence ends, repeated, or as the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == EMPTIED, "").when(kind == CUT, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == CAST, "user").otherwise(F.col("role"))
    copies = F.when(kind == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    others = [c for c in rows.columns if c not in ("text", "role", "copy", "gone")]
    return rows.select(*others, role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind == DROPPED).alias("gone"))


def _repair_sql() -> str:
    more = lambda way, cost, letter, line: f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {way}.t || {line}}}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    inserted = ", ".join(
        [
            "v0 AS w0", "v1 AS w1",
            f"list_min([v2, {', '.join(more(v, 5, 'I', user) for v in ('v0', 'v1', 'v3'))}]) AS w2",
            f"list_min([v3, {more('v2', 5, 'I', assistant)}, {', '.join(more(v, 10, 'II', f'{user} || {assistant}') for v in ('v0', 'v1'))}]) AS w3",
        ]
    )
    extra = "CASE fault WHEN 3 THEN 5 ELSE 0 END"
    kept = lambda way, initial: (
        f"CASE WHEN fault IN (1, 2) THEN NULL WHEN initial = '{initial[0]}' THEN {more(way, extra, 'K', 'line')} ELSE {more(way, f'1 + {extra}', 'R', f'chr(10) || {initial!r} || text')} END"
    )
    system = f"CASE WHEN fault NOT IN (1, 2) AND initial = 's' THEN {more('w0', extra, 'K', 'line')} END"
    dropped = [more(f"w{i}", 2, "D", "''") for i in range(4)]
    step = ", ".join(
        [
            f"{dropped[0]} AS v0", f"list_min([{dropped[1]}, {system}]) AS v1",
            f"list_min([{dropped[2]}, {', '.join(kept(w, 'user:') for w in ('w0', 'w1', 'w3'))}]) AS v2", f"list_min([{dropped[3]}, {kept('w2', 'assistant:')}]) AS v3",
        ]
    )
    nothing = "{'c': 1000000000, 'a': '', 't': ''}"
    return rf"""WITH RECURSIVE named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_reduce(flatten([[4294967295], flatten([[CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                                    FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')])]),
                           lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
        FROM conversations
    ), hurt AS (
        SELECT conv_id, turn, role AS role0, text AS text0, xor(crc, 4294967295) % 20 AS k, unnest(CASE xor(crc, 4294967295) % 20 WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM named
    ), rows AS (
        SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role0 END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text0, '.!?', '') ELSE text0 END AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS i FROM hurt WHERE k <> 0
    ), seen AS (
        SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
               lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows
    ), faulty AS (
        SELECT conv_id, turn, i, text, left(role, 1) AS initial, chr(10) || role || ':' || text AS line,
               CASE WHEN bare = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
               before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM seen
    ), steps AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS v0, {nothing} AS v1, {nothing} AS v2, {nothing} AS v3 FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, i, {step} FROM (
            SELECT f.conv_id, f.i, f.text, f.initial, f.line, f.fault, {inserted} FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)
    ), best AS (
        SELECT conv_id, list_min([v0, v3, {more('v2', 5, 'I', assistant)}]) AS way
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS n FROM steps) WHERE n = 1
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
               count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id
    )
    SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(way.c AS BIGINT) AS cost, way.a AS audit, sha256(substr(way.t, 2)) AS repaired_sha256
    FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""


@register(QUERIES, _repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults, the cheapest repair and the hash of what it gives."""
    rows, found = repair.repair(damaged(repair.ordered(table(spark, sf_dir, "conversations"))))
    hashes = repair.digests(rows, found).withColumnRenamed("conv_id", "__conv")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")

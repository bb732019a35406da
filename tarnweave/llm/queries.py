"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm import annsearch, bpe, chatformat, decontaminate, filteraudit, langid, licenses, linededup, quality, simhash, suffixdedup, variants, warc
from tarnweave.session import scratch_path, table


def vocabulary() -> str:
    """The vocabulary file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    archive = warc.write_archive(pages, path)
    warc.write_warc(spark, path, f"{path}/warc")
    kind = pages.schema["page_id"].dataType
    found = warc.records(spark, f"{path}/warc", archive)
    return found.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_notices(table(spark, sf_dir, "documents"))


def op3_chatformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chatformat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
    return rows.withColumn("mask", spans)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summarise(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_annsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return annsearch.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op2_notices": op2_notices,
    "op3_chatformat": op3_chatformat,
    "op4_bpe": op4_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_linededup": op6_linededup,
    "op7_simhash": op7_simhash,
    "op8_annsearch": op8_annsearch,
    "op9_suffixdedup": op9_suffixdedup,
    "op10_quality": op10_quality,
    "op11_variants": op11_variants,
    "op12_langid": op12_langid,
    "op13_filteraudit": op13_filteraudit,
}


def _license_sql() -> str:
    """The licence scan in SQL, with the same templates."""
    rows = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
        WITH t AS (SELECT * FROM (VALUES {rows}) AS v(name, body)),
        tw AS (SELECT name, {words.format("body")} AS w FROM t),
        tp AS (SELECT name, {pairs.format("w")} AS p FROM tw),
        u AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body FROM documents
              UNION ALL SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) FROM documents WHERE contains(text, chr(10) || chr(10))
              UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
        uw AS (SELECT doc_id, row_number() OVER () AS u, {words.format("body")} AS w FROM u),
        up AS (SELECT doc_id, u, len({pairs.format("w")}) AS n, {pairs.format("w")} AS p FROM uw WHERE len(w) > 1),
        ue AS (SELECT doc_id, u, n, unnest(p) AS x FROM up),
        te AS (SELECT name, len(p) AS m, unnest(p) AS x FROM tp),
        c AS (SELECT doc_id, u, name, 2.0 * count(*) / (max(n) + max(m)) AS score FROM ue JOIN te ON ue.x = te.x GROUP BY doc_id, u, name),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY score DESC, name) AS k FROM c WHERE score >= {licenses.THRESHOLD}),
        d AS (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE k = 1),
        a AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM b WHERE k = 1) GROUP BY doc_id)
        SELECT doc_id, d.name AS license, round(d.score, 6) AS score, CAST(coalesce(d.n, 0) AS BIGINT) AS n_units, coalesce(a.names, '') AS licenses
        FROM documents LEFT JOIN (SELECT * FROM d WHERE k = 1) d USING (doc_id) LEFT JOIN a USING (doc_id)
    """


ORACLE: dict[str, str] = {
    "op2_licenses": _license_sql(),
    "op3_chatformat": """
        WITH s AS (
          SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN replace(regexp_replace(trim(role), '[\r\n]', ' ', 'g'), '<|im_', '<| im_') ELSE 'unknown' END AS role,
                 replace(coalesce(text, ''), '<|im_', '<| im_') AS body FROM conversations),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) - 1 AS k FROM s),
        w AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
        y AS (SELECT conv_id, arg_min(body, k) AS body FROM r WHERE role = 'system' GROUP BY conv_id),
        p AS (SELECT r.conv_id, perspective, CAST(k // 256 AS BIGINT) AS segment, k, role, body FROM r JOIN w ON r.conv_id IS NOT DISTINCT FROM w.conv_id),
        c AS (
          SELECT * FROM p UNION ALL
          SELECT DISTINCT p.conv_id, perspective, segment, -1, 'system', y.body FROM p JOIN y ON p.conv_id IS NOT DISTINCT FROM y.conv_id WHERE segment > 0),
        h AS (
          SELECT *, role = perspective AS own,
                 '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head FROM c),
        q AS (
          SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
          FROM h WINDOW o AS (PARTITION BY conv_id, perspective, segment ORDER BY k))
        SELECT conv_id, perspective, segment, count(*) FILTER (k >= 0) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
               string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
               coalesce(string_agg(CASE WHEN own THEN CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(body) + 10 AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS mask
        FROM q GROUP BY conv_id, perspective, segment
    """,
    "op1_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    "op5_decontaminate": r"""
        WITH dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        iw AS (
          SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        ip AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0),
        ig AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM ip),
        sizes AS (SELECT DISTINCT n FROM ig),
        dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n),
        dg AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM dp),
        hit AS (SELECT doc_id, dg.n AS n, i, item_id FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g),
        spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit),
        nh AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
        iu AS (SELECT item, item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, ws FROM iw))),
        io AS (SELECT item, item_id, i - 1 AS off, ws[i] AS term FROM iu),
        du AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw),
        dt AS (SELECT doc_id, i - 1 AS pos, ws[i] AS term FROM du WHERE ws[i] IN (SELECT term FROM io)),
        tc AS (SELECT term, count(*) AS n FROM dt GROUP BY term),
        rk AS (SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY n, term) AS k, count(*) OVER (PARTITION BY item) AS m FROM (SELECT DISTINCT item, term FROM io) JOIN tc USING (term)),
        nt AS (SELECT io.item, io.item_id, io.term, off, least(3, least(4, m)) AS need FROM io JOIN rk ON io.item = rk.item AND io.term = rk.term WHERE k <= 4 AND m > 1),
        mv AS (SELECT doc_id, item, item_id, nt.term, need, pos - off AS shift FROM dt JOIN nt ON dt.term = nt.term),
        pm AS (SELECT a.doc_id, a.item, a.item_id, a.shift FROM mv a JOIN mv b ON a.doc_id = b.doc_id AND a.item = b.item AND b.shift BETWEEN a.shift AND a.shift + 8
               GROUP BY a.doc_id, a.item, a.item_id, a.shift HAVING count(DISTINCT b.term) >= max(a.need)),
        nn AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item_id FROM pm) GROUP BY doc_id),
        ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
        FROM dw LEFT JOIN nh ON dw.doc_id = nh.doc_id LEFT JOIN ni ON dw.doc_id = ni.doc_id LEFT JOIN nn ON dw.doc_id = nn.doc_id
    """,
    "op11_variants": r"""
        WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        g AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
        o AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM g WHERE length(raw) >= 7),
        r AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY doc_id, run),
        b AS (SELECT r.*, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS bytes FROM r),
        h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, tab),
        d AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
        p AS (SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS swap, left(word, i - 1) || substr(word, i + 1) AS less FROM s),
        l AS (SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.swap = b.swap AND a.word <> b.word
              UNION SELECT p.word, w.word, w.n FROM p JOIN w ON less = w.word UNION SELECT w.word, p.word, p.n FROM p JOIN w ON less = w.word),
        k AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM l),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN (SELECT * FROM k WHERE k = 1) k ON w.word = k.word),
        chain AS MATERIALIZED (
          WITH RECURSIVE c(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
          SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON f.word = chain.word
    """,
    "op13_filteraudit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
        m AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
                     + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > low, false) AS INT) AS mask FROM w),
        l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
              WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
        r AS (SELECT part, filter_order, step, bit,
                CAST(sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
    """,
}

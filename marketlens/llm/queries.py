"""One query per operator over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    chat,
    decontamination,
    hash_tree,
    html_text,
    jaccard_join,
    language_id,
    m_tree,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    spelling,
    token_counts,
)
from marketlens.llm._shared import id_crc, read_table, ship_code

GOOD_FROM = 0.3  # a document is kept (predicted 1) from this score on


def usable_quality_label():
    return F.pmod(id_crc("doc_id"), F.lit(5)) != 0


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the benchmark items found in it and the best similarity."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_hits(docs, read_table(spark, sf_dir, "benchmark"), "hits")
    return marked.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_hits"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("items"),
        F.array_max(F.transform("hits", lambda h: h["similarity"])).alias("similarity"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned, names = secret_scan.scan(docs, secret_scan.train(docs))
    count = lambda kind: F.size(names[kind]).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(names, secret_scan.KINDS[:3]), 256).alias("base_sha256"),
        secret_scan.joined(names, secret_scan.KINDS).alias("spans"),
        count("markov").alias("n_markov"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc("doc_id"), F.lit(4)) == 2
    model = language_id.fit(docs, ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), usable_quality_label())
    scored = quality.score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id",
        (~usable_quality_label()).alias("held_out"),
        "score",
        F.when(F.col("score") >= GOOD_FROM, F.lit(1)).otherwise(F.lit(0)).alias("predicted"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is read back from the formatted windows."""
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    windows = chat.format_windows(rows)
    turns = chat.read_turns(F.col("formatted"))
    fresh = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - F.col("n_repeated"), F.lit(0)))
    part = F.struct(
        F.col("window"),
        fresh.alias("turns"),
        chat.read_targets(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = windows.select("conv_id", part.alias("w")).groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_tree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in ten gets a repeating tail, as the contract says, before the scan."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    h = id_crc("doc_id")
    n, g = F.greatest(F.size("w"), F.lit(1)), F.floor(h / 10)
    period = 1 + F.floor((n - F.col("a")) / (3 + g % 8))
    tail = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    altered = F.transform("w", lambda _, i: F.get("w", tail(i).cast("int")))
    docs = (
        docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(periodic_runs.WORD), F.lit(0))))
        .withColumn("a", g % n)
        .withColumn("p", period)
        .select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(altered, " ")).otherwise(F.col("text")).alias("text"))
    )
    marked, names = periodic_runs.mark_runs(docs)
    runs = F.col(names["runs"])
    said = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return marked.withColumn("best", periodic_runs.strongest(runs)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(said, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2(names["collapsed"], 256).alias("collapsed_sha256"),
    )


def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions of two racks of four shards; the law is ``key``."""
    tree = hash_tree.even_tree(40)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = hash_tree.place(rows, tree, F.col("doc_id"), "shard")
    placed = hash_tree.place(placed, tree.grown(), F.col("doc_id"), "grown_shard")
    return hash_tree.shard_rows(placed, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of letters in 97 loses a code point, as the contract says, before the count."""
    runs = spelling.runs_of_letters(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variant_forms(spelling.word_counts(words))


_QUERIES = (
    op1_decontaminate,
    op2_secrets,
    op3_html_text,
    op4_language,
    op5_quality,
    op6_chat,
    op7_pack,
    op8_top_k,
    op9_jaccard_join,
    op10_token_counts,
    op11_periodic_runs,
    op12_hash_tree,
    op13_spelling_variants,
)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, after the workers have been given this package's code."""

    def run(spark: SparkSession, *args) -> DataFrame:
        ship_code(spark)
        return query(spark, *args)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: shipped(q) for q in _QUERIES}


def _crc_sql(text: str) -> str:
    """crc32 of a text in SQL: the bits of the reversed polynomial, byte by byte."""
    octets = f"[('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode({text})), '..')]"
    shifted = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {shifted}), 4294967295)"


def _draw_sql(path: str) -> str:
    """-ln(u) of a node: u from 52 bits of md5(id || path)."""
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || {path}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_periodic_runs": rf"""
            WITH hashed AS (
              SELECT row_number() OVER () AS r, doc_id, {_crc_sql("coalesce(doc_id::VARCHAR, '')")} AS h,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
              FROM documents
            ),
            docs AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM hashed),
            words AS (
              SELECT r, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a
                THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END] AS word, n
              FROM (SELECT *, unnest(range(n)) AS i FROM docs)
            ),
            pairs AS (
              SELECT x.r, x.i, y.i - x.i AS q
              FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
            ),
            stretches AS (
              SELECT r, q, min(i) AS start, count(*) + q AS length
              FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
              GROUP BY r, q, island
              HAVING count(*) + q >= greatest(6, 4 * q)
            ),
            runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
            listed AS (
              SELECT r, count(*) AS n_runs,
                     string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
              FROM runs GROUP BY r
            ),
            best AS (
              SELECT * FROM runs
              QUALIFY row_number() OVER (PARTITION BY r ORDER BY length * 1.0 / period DESC, start, period) = 1
            ),
            dropped AS (
              SELECT DISTINCT words.r, words.i
              FROM words JOIN runs ON words.r = runs.r AND i >= start + period AND i < start + length
            ),
            kept AS (
              SELECT r, string_agg(word, ' ' ORDER BY i) AS said
              FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
            )
            SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
                   period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
                   sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(said, '')) AS collapsed_sha256
            FROM docs LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
        """,
        "op12_hash_tree": f"""
            WITH rows AS (
              SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
                     {_crc_sql("coalesce(text, '')")}::BIGINT AS text_crc32
              FROM documents
            ),
            regions AS (
              SELECT *, list_transform(range(5), lambda i: {{'draw': {_draw_sql("'/' || i")} / 8, 'child': i}}) AS draws,
                     {{'draw': {_draw_sql("'/5'")} / 1, 'child': 5}} AS added
              FROM rows
            ),
            racks AS (
              SELECT *, list_min(draws).child AS region, list_min(list_append(draws, added)).child AS grown_region FROM regions
            ),
            shards AS (
              SELECT *, list_min(list_transform(range(2), lambda i: {{'draw': {_draw_sql("'/' || region || '/' || i")} / 4, 'child': i}})).child AS rack
              FROM racks
            ),
            placed AS (
              SELECT *, (8 * region + 4 * rack + list_min(list_transform(range(4), lambda i:
                {{'draw': {_draw_sql("'/' || region || '/' || rack || '/' || i")}, 'child': i}})).child)::INTEGER AS shard
              FROM shards
            ),
            grown AS (SELECT *, CASE WHEN grown_region = 5 THEN 40 ELSE shard END::INTEGER AS grown_shard FROM placed)
            SELECT doc_id, size, text_crc32, 'key' AS law, shard,
                   row_number() OVER (PARTITION BY shard ORDER BY
                     md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':' || grown_shard)) - 1 AS slot,
                   grown_shard
            FROM grown
        """,
        "op13_spelling_variants": rf"""
            WITH RECURSIVE runs AS (
              SELECT coalesce(doc_id::VARCHAR, '') AS id,
                     translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                               '{spelling.CAPITALS}', '{spelling.SMALL}') AS run
              FROM documents
            ),
            hashed AS (SELECT run, {_crc_sql("id || ':' || run")} AS h FROM runs),
            said AS (
              SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                     ELSE run END AS word
              FROM hashed
            ),
            words AS (SELECT word, count(*) AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
            holes AS (
              SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
              FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
            ),
            near AS (
              SELECT a.word, b.word AS near, b.n AS near_n
              FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
              UNION SELECT holes.word, words.word, words.n FROM holes JOIN words ON words.word = holes.head || holes.tail
              UNION SELECT words.word, holes.word, holes.n FROM holes JOIN words ON words.word = holes.head || holes.tail
            ),
            best AS (
              SELECT word, count(*) AS n_near, max(near_n) AS best_n,
                     arg_min(near, {{'n': -near_n, 'near': encode(near)}}) AS near
              FROM near GROUP BY word
            ),
            forms AS (
              SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN near END AS form,
                     CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
              FROM words LEFT JOIN best USING (word)
            ),
            chains(word, root) AS (
              SELECT word, word FROM forms
              UNION ALL
              SELECT chains.word, forms.form FROM chains JOIN forms ON chains.root = forms.word WHERE forms.form IS NOT NULL
            )
            SELECT forms.word, forms.form, chains.root, forms.n, forms.n_near, forms.form_n
            FROM forms JOIN chains USING (word) JOIN forms last ON last.word = chains.root
            WHERE last.form IS NULL
        """,
        "op6_chat": r"""
            WITH RECURSIVE spoken AS (
              SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL
              SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
            ),
            sized AS (
              SELECT *, row_number() OVER ordered - 1 AS i,
                     len(regexp_extract_all(text, '\w+|[^\w\x09-\x0D\x20]')) + 2 AS size,
                     20 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS chars
              FROM spoken
              WINDOW ordered AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
            ),
            turns AS (
              SELECT *, sum(size) OVER upto AS upto, sum(size) OVER upto - size AS before,
                     sum(chars) OVER upto AS chars_upto, sum(chars) OVER upto - chars AS chars_before
              FROM sized
              WINDOW upto AS (PARTITION BY conv_id ORDER BY i)
            ),
            convs AS (
              SELECT conv_id, count(*) AS n, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS lead,
                     max(CASE WHEN i = 0 AND role = 'system' THEN upto ELSE 0 END) AS head,
                     max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) AS head_chars,
                     sum(chars) AS all_chars,
                     string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
                     coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss
              FROM turns GROUP BY conv_id
            ),
            repeats AS (
              SELECT t.conv_id, t.i, coalesce(min(b.before), t.before) AS from_before,
                     coalesce(min(b.chars_before), t.chars_before) AS from_chars
              FROM turns t JOIN convs c ON t.conv_id IS NOT DISTINCT FROM c.conv_id
              LEFT JOIN turns b ON t.conv_id IS NOT DISTINCT FROM b.conv_id
                AND b.i BETWEEN greatest(c.lead, t.i - 64) AND t.i
                AND t.before - b.before <= least(128, 512 - c.head - t.size)
              GROUP BY t.conv_id, t.i, t.before, t.chars_before
            ),
            windows(conv_id, w, opens, from_before, from_chars, head) AS (
              SELECT conv_id, 0, 0::BIGINT, 0::HUGEINT, 0::HUGEINT, head FROM convs
              UNION ALL
              SELECT x.conv_id, x.w + 1, x.opens, r.from_before, r.from_chars, x.head
              FROM (
                SELECT p.conv_id, p.w, p.head, min(t.i) AS opens
                FROM windows p JOIN turns t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i > p.opens
                  AND CASE WHEN p.opens = 0 THEN 0 ELSE p.head END + t.upto - p.from_before > 512
                GROUP BY p.conv_id, p.w, p.head
              ) x
              JOIN repeats r ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.opens = r.i
            ),
            cut AS (
              SELECT p.*, t.chars_before, lead(t.chars_before) OVER (PARTITION BY p.conv_id ORDER BY p.w) AS stop
              FROM windows p JOIN turns t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.opens = t.i
            ),
            formatted AS (
              SELECT cut.conv_id, count(*) AS n_windows,
                     sum(coalesce(stop, all_chars) - from_chars + CASE WHEN opens > 0 THEN head_chars ELSE 0 END) AS formatted_chars
              FROM cut JOIN convs ON cut.conv_id IS NOT DISTINCT FROM convs.conv_id
              GROUP BY cut.conv_id
            )
            SELECT convs.conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
                   sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, n_windows
            FROM convs JOIN formatted ON convs.conv_id IS NOT DISTINCT FROM formatted.conv_id
        """,
        "op8_top_k": """
            WITH usable AS (
              SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
              FROM embeddings
              WHERE embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
            ),
            scored AS (
              SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
              WHERE q.vec_id % 100 = 0
            )
            SELECT query_id,
                   (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
                   vec_id, score
            FROM scored
            QUALIFY rank <= 10
        """,
        "op9_jaccard_join": r"""
            WITH RECURSIVE words AS (
              SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')),
                '[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{3FFFF}]|'
                '[0-9a-z_\x{80}-\x{9F}\x{C0}-\x{DFF}\x{F00}-\x{FFF}\x{10A0}-\x{177F}\x{1800}-\x{1FFF}\x{2080}-\x{2FFF}'
                '\x{3100}-\x{33FF}\x{4DC0}-\x{4DFF}\x{A000}-\x{1FFFF}\x{40000}-\x{10FFFF}]+') AS w
              FROM documents
            ),
            grams AS (
              SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
            ),
            sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
            links AS (
              SELECT a.doc_id AS a, b.doc_id AS b
              FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
              JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n
              HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9
            ),
            reach(a, b) AS (
              SELECT a, b FROM links
              UNION
              SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
            )
            SELECT d.doc_id,
                   least(d.doc_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
                   (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
            FROM documents d
        """,
    }

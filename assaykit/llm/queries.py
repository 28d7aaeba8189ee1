"""One query per operator over the given tables; each takes its rows from the operator and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import alignment, licences, media_ogg, packing, pii, pieces_scan, quality, ranked_trie, warc
from assaykit.llm.common import WORD_GAP, text_key
from assaykit.llm.permutation_index import nearest
from assaykit.llm.recompression import repeated_words
from assaykit.llm.signature_trees import near_duplicates
from assaykit.llm.suffix_index import repeated_bytes


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: no more than this many rows go to Python at once. A setting of the caller's session, so entry points alone change it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _by_text(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Each document with what was made of its text."""
    return docs.select("doc_id", *text_key(F.col("text"))).join(made, ["h1", "h2"], "left").drop("h1", "h2")


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"not ({HELD_OUT})")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(text)
    padding = F.when(size == 0, 64).otherwise(F.pmod(-size, F.lit(64)))
    padded = F.concat(text, F.repeat(F.lit("\0"), padding.cast("int")).cast("binary"))
    docs = _documents(spark, sf_dir).select("doc_id", size.cast("long").alias("n_bytes"), padded.alias("payload"))
    media = media_ogg.encode(docs, "payload").drop("payload")
    made = media_ogg.decode(media)
    back = F.col("decoded.samples")
    return made.select(
        "doc_id", "n_bytes", F.length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"), F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("decoded.feature").alias("feature"), F.col("decoded.error").alias("error"),
    )


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.pack(_documents(spark, sf_dir), path)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    made = licences.scan(docs, licences.train(docs)).withColumn("sure", F.filter("licences", lambda x: x["confirmed"]))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",")
    return made.select("doc_id", F.size("licences").alias("n_predicted"), F.size("sure").alias("n_confirmed"), families.alias("families"), F.array_max(F.transform("sure", lambda x: x["p"])).alias("p"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    made = pii.replace(docs, pii.key_of(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return made.select("doc_id", F.size("entities").alias("n_entities"), kinds.alias("kinds"), "text")


def op8_piece_scan(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    made = pieces_scan.decode(pieces_scan.encode(docs, path), path)
    whole = F.coalesce("text", F.lit(""))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == whole).alias("round_trip"))


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs, words=4, num=85, den=100, columns=["doc_id"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    made = repeated_bytes(docs, 200).select(
        "h1", "h2", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    return _by_text(docs, made)


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    words = F.regexp_replace(F.regexp_replace("kept", WORD_GAP, " "), "^ | $", "")
    made = repeated_words(docs, 35).select("h1", "h2", "n_words", removed.alias("n_removed"), F.sha2(words, 256).alias("kept_sha256"))
    return _by_text(docs, made)


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = warc.through_archives(pages, F.col("page_id"), F.col("url"), F.col("html"))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    return made.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return alignment.align_documents(docs, a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))


def op13_ranked_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_trie.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": op1_compression_quality,
    "op2_ogg_media": op2_ogg_media,
    "op3_permutation_index": op3_permutation_index,
    "op4_packing": op4_packing,
    "op5_licence_scan": op5_licence_scan,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op8_piece_scan": op8_piece_scan,
    "op7_signature_trees": op7_signature_trees,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_recompression_dedup": op10_recompression_dedup,
    "op11_warc_archives": op11_warc_archives,
    "op12_lockstep_alignment": op12_lockstep_alignment,
    "op13_ranked_trie": op13_ranked_trie,
}

#: The contracts in SQL, straight from their wording: all sets, all windows, no index.
ORACLE_SQL: dict[str, str] = {
    "op7_signature_trees": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
        one AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 85 * (a.n + b.n - COUNT(*))),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id AS node, doc_id AS lead FROM sets UNION SELECT l.b, r.lead FROM reach r JOIN links l ON l.a = r.node WHERE r.lead < l.b)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, MIN(r.lead) AS component_id FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
        hit AS (SELECT r, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING COUNT(*) > 1)),
        runs AS (SELECT r, MIN(i) AS a, MAX(i) + 200 AS b FROM (SELECT r, i, SUM(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 THEN 1 ELSE 0 END AS fresh FROM hit)) GROUP BY r, g),
        gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y, b - a AS n, b AS e FROM runs),
        kept AS (SELECT r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS front, MAX(e) AS e, SUM(n) AS n_removed, COUNT(*) AS n_spans FROM gaps JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op10_recompression_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        hit AS (SELECT r, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING COUNT(*) > 1)),
        gone AS (SELECT DISTINCT r, i + o AS p FROM hit, range(0, 35) t(o)),
        kept AS (SELECT c.r, string_agg(c.word, ' ' ORDER BY c.p) AS body, COUNT(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) c ANTI JOIN gone g ON g.r = c.r AND g.p = c.p GROUP BY c.r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op11_warc_archives": r"""
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS html, MIN(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
    "op13_ranked_trie": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t, row_number() OVER () AS r FROM documents),
        q AS (SELECT item_id, t, COUNT(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
        total AS (SELECT COUNT(*) FILTER (len(t) > 0) AS n_docs, SUM(len(t))::BIGINT AS n_terms FROM d),
        post AS (SELECT r, t, COUNT(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY r, t),
        df AS (SELECT t, COUNT(*) AS df FROM post GROUP BY t),
        w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
        m AS (SELECT r, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0),
        s AS (SELECT item_id, doc_id, r, CAST(SUM(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN post USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r)
        SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 20""",
}

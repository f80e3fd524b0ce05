"""The registered queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import bpe, centroids, chat, decontam, filteraudit, langid, licenses, linededup, neardup, pages, quality, sharding, toxicity
from fidelis.llm.common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the marks, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-copies among all documents: three-word shingles, a Jaccard similarity of 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold of three isn't 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    prototypes = langid.train(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a license notice, with the license and the share of the notice that they hold."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("containment", 4).alias("containment"))


def op5_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those whose fold of five isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer_file())
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the item and the best overlap."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that are left when recurring templates are dropped but for their first document."""
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), "text")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster among 16 after three rounds, with exact distances, inertia and centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("centroid")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each language, in every order of the filters."""
    return filteraudit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_minhash": op2_minhash,
    "op3_hyperdimensional": op3_hyperdimensional,
    "op4_license_bands": op4_license_bands,
    "op5_compression": op5_compression,
    "op6_site_templates": op6_site_templates,
    "op7_bpe": op7_bpe,
    "op8_crf_quality": op8_crf_quality,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_line_templates": op10_line_templates,
    "op11_centroids": op11_centroids,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_shards": op13_prefix_shards,
}

TOKENS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
NOTICES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, ts in licenses.TEMPLATES.items() for t in ts)
GRAMS = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"

def _centroid_sql(rounds: int = 3) -> str:
    """Each round's assignment and means, one after the other."""
    steps = [
        """k AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64)""",
        "v AS (SELECT r, vec_id, unnest(range(64)) AS i, unnest(q) AS x FROM k)",
        """m0 AS (SELECT c, unnest(range(64)) AS i, unnest(q) AS x FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c FROM k) WHERE c < 16)""",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, vec_id, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM v JOIN m{n} m USING (i) GROUP BY ALL)")
        steps.append(f"a{n} AS (SELECT r, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)")
        mean = "(sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*)"
        steps.append(f"s{n} AS (SELECT c, i, ({mean})::BIGINT AS x FROM v JOIN a{n} USING (r) GROUP BY c, i)")
        steps.append(f"m{n + 1} AS (SELECT c, i, coalesce(s.x, m.x) AS x FROM m{n} m LEFT JOIN s{n} s USING (c, i))")
    return f"""WITH {", ".join(steps)}, h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
 SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""


AUDIT_SQL = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
 f AS (SELECT part, len(w) < 100 AS "A", 100 * len(list_distinct(w)) < 80 * len(w) AS "B", 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 10 * length(x) AS "C",
  regexp_matches(x, '[#$%&*|]') AS "D", coalesce(doc_id > low, false) AS "E", coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
 m AS (SELECT part, list_filter([CASE WHEN "A" THEN 'A' END, CASE WHEN "B" THEN 'B' END, CASE WHEN "C" THEN 'C' END, CASE WHEN "D" THEN 'D' END, CASE WHEN "E" THEN 'E' END], lambda x: x IS NOT NULL) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
 o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
 s AS (SELECT filter_order, k AS step, filter_order[k] AS f, string_split(filter_order[1:k - 1], '') AS others FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
 r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT list_has_any(fails, list_append(others, f))), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, others)), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, others)), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = [f]), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (good AND list_contains(fails, f) AND NOT list_has_any(fails, others)), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (toxic AND list_contains(fails, f) AND NOT list_has_any(fails, others)), 0)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
 SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

#: CRC-32 by bytes, with its table worked out from the polynomial; groups that a target falls into stay whole where they are small.
SHARD_SQL = """WITH RECURSIVE bits AS (SELECT n, 0 AS k, n AS c FROM (SELECT unnest(range(256)) AS n) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
 crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
 t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
 z AS (SELECT doc_id, strlen(x) + 1 AS size, md5(x) AS g, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM t, crc),
 p AS (SELECT *, (sum(size) OVER w - size)::BIGINT AS start, row_number() OVER w AS nth FROM z WINDOW w AS (ORDER BY g, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
 e AS (SELECT sum(size)::BIGINT AS total FROM z), cut AS (SELECT i, total, total * i // 8 AS target FROM e, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS i)),
 gr AS (SELECT g, min(start) AS a, max(start + size) AS b FROM p GROUP BY g),
 ends AS (SELECT i, CASE WHEN least(target - a, b - target) > 0.005 * total / 8 THEN target WHEN target - a <= b - target THEN a ELSE b END AS stop FROM cut JOIN gr ON a <= target AND target < b),
 s AS (SELECT p.*, (SELECT count(*) FROM ends WHERE stop <= start)::INT AS shard FROM p)
 SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

#: Queries that SQL can express: license notices by their shingles; benchmark passages by every alignment that shares
#: three tokens in a row, which a stretch of 6 to 16 tokens with a fifth replaced does (two of 5, all of fewer).
ORACLE_SQL: dict[str, str] = {
    "op11_centroids": _centroid_sql(),
    "op12_filter_audit": AUDIT_SQL,
    "op13_prefix_shards": SHARD_SQL,
    "op4_license_bands": f"""WITH t AS (SELECT license, {GRAMS} AS g FROM (SELECT license, {TOKENS.format('text')} AS w FROM (VALUES {NOTICES}) v(license, text))),
 d AS (SELECT doc_id, {GRAMS} AS g FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents) WHERE len(w) >= 3),
 m AS (SELECT doc_id, license, len(list_intersect(t.g, d.g)) / len(t.g) AS c FROM d, t)
 SELECT doc_id, license, round(max(c), 4) AS containment FROM m WHERE c >= 0.8 - 1e-9 GROUP BY doc_id, license""",
    "op9_spaced_seeds": f"""WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), i AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark),
 k AS (SELECT item_id, w, CASE WHEN len(w) > 5 THEN 3 WHEN len(w) = 5 THEN 2 ELSE len(w) END AS k FROM i WHERE len(w) > 0),
 dg AS (SELECT doc_id, w, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM k))),
 ig AS (SELECT item_id, w, q, k, array_to_string(w[q:q + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS q FROM k)),
 a AS (SELECT DISTINCT doc_id, item_id, dg.w AS dw, ig.w AS iw, p - q AS o FROM dg JOIN ig USING (k, g)),
 s AS (SELECT *, unnest(range(1, len(iw) - least(16, len(iw)) + 2)) AS s FROM a),
 c AS (SELECT doc_id, item_id, least(16, len(iw)) AS compared, o + s - 1 AS doc_at,
  len(list_filter(range(s, s + least(16, len(iw))), lambda k: k + o >= 1 AND coalesce(dw[k + o] = iw[k], false))) AS matched FROM s)
 SELECT doc_id, item_id, max(matched) AS matched, any_value(compared) AS compared, arg_min(greatest(doc_at, -1000000), -matched * 10000000 + doc_at) AS doc_at
 FROM c WHERE matched >= ceil(0.8 * compared - 1e-9) GROUP BY doc_id, item_id""",
}

"""The registered queries of this subpackage: thin wrappers that apply an operator
with production parameters to its whole table and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bloom_lm, bpe, chosen_path, codewords, dac, fm_index, mil, periods, prefix_forest, prefix_trie, toxicity, urls, warc
from gaugeworks.llm.common import remainder, table
from gaugeworks.llm.training import labelled_sample


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Lexicon:
    """Learned from labels of documents whose remainder by 3 isn't 1."""
    allowed = remainder(F.col("doc_id"), 3) != 1
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return toxicity.train(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", allowed, toxicity.PER_CLASS))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> mil.Model | None:
    """Learned from labels of documents whose remainder by 4 isn't 2."""
    allowed = remainder(F.col("doc_id"), 4) != 2
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return mil.train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", allowed, mil.PER_CLASS))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    scored = toxicity.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    scored = mil.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class under Jaccard similarity of five-word n-grams, and its links."""
    return chosen_path.similar_documents(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and bigram log probabilities of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("train", remainder(F.col("doc_id"), 10) != 0)
    return bloom_lm.score_corpus(docs, train_col="train").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.digest_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = codewords.train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return codewords.identify(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


#: (verdict, host and path) of the registered query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, those inside benchmark windows, and the items hit."""
    found = fm_index.find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids written in directly addressable codes and read back."""
    return dac.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), end_id=2)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations, node by node."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), rebuild=True)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, every tenth of which is made periodic first."""
    return periods.period_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_lm_score": op3_lm_score,
    "op4_quality": op4_quality,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_language": op6_language,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_nearest": op9_nearest,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_warc": op12_warc,
    "op13_periods": op13_periods,
}

#: The words of a text in DuckDB, as ``fm_index.WORD`` takes them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 of the decimal c in DuckDB, bit by bit (fixed value: the polynomial 0xEDB88320).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * length(c::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii((c::VARCHAR)[i // 8 + 1])::UBIGINT ELSE 0::UBIGINT END)),
    lambda s, b: CASE WHEN xor(s, b) % 2 = 1 THEN xor(xor(s, b) // 2, 3988292384::UBIGINT) ELSE xor(s, b) // 2 END), 4294967295::UBIGINT)"""

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS same FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY 1), l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1), m AS (SELECT same, min(doc_id) AS copy_id FROM n GROUP BY 1)
SELECT w.doc_id, class_id, coalesce(copy_id, w.doc_id) AS copy_id, coalesce(n_links, 0) AS n_links FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (same) LEFT JOIN l ON l.doc_id = w.doc_id""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
f AS (SELECT doc_id, i, o.n, item_id FROM o JOIN p ON o.n = p.n AND o.s = p.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM f) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_prefix_trie": f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, {_CRC32} % 6 AS h FROM o GROUP BY c),
u AS (SELECT n.c, o.i, o.r, o.t FROM n JOIN o ON o.c = n.c - n.c % 100 AND o.i < n.h UNION ALL SELECT n.c, o.i + 100, o.r, o.t FROM n JOIN o ON o.c = n.c AND o.i >= n.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, r, t FROM u),
l AS (SELECT n.c, coalesce(max(d), 0) AS l FROM n LEFT JOIN s ON s.c = n.c GROUP BY n.c),
w AS (SELECT c, d, length(t) AS z, string_agg(sha256(sha256(r) || t), '/') OVER (PARTITION BY c ORDER BY d) AS k FROM s),
p AS (SELECT c, 0 AS d, 0 AS z, '' AS k FROM n UNION ALL SELECT c, d, z, sha256(k) FROM w),
g AS (SELECT k, d, any_value(z) AS z, min(c) AS m, count(*) AS n FROM p GROUP BY k, d),
a AS (SELECT DISTINCT x.k AS k, y.k AS up FROM p x JOIN p y ON x.c = y.c AND x.d = y.d + 1),
kids AS (SELECT up AS k, count(*) AS n FROM a GROUP BY 1),
below AS (SELECT DISTINCT x.k AS top, y.k AS k FROM p x JOIN p y ON x.c = y.c AND y.d >= x.d),
sums AS (SELECT top AS k, count(*) FILTER (kids.n IS NULL) AS leaves, sum((g.n - 1) * g.z) AS saved FROM below JOIN g ON g.k = below.k LEFT JOIN kids ON kids.k = below.k GROUP BY 1),
ends AS (SELECT p.k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN l ON l.c = p.c AND l.l = p.d GROUP BY 1)
SELECT g.m AS conv_id, g.d::BIGINT AS depth, up.m AS parent_conv_id, g.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN sums USING (k) LEFT JOIN kids ON kids.k = g.k LEFT JOIN a ON a.k = g.k LEFT JOIN g up ON up.k = a.up LEFT JOIN ends ON ends.k = g.k""",
    "op12_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n < 100 OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM f""",
}

"""The registered queries of the llm operators, over whole tables, and their SQL where SQL expresses them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import collocations, embedding_dedup, exact_dedup, fill_middle, language_id, mixing, pii, quality, sentencepiece_nbest, simhash, suffix_dedup, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The vocabulary file of the SentencePiece queries, and how many segmentations they ask for.
PIECES, N_BEST = "/opt/tokenizers/piece_bpe_32k.model", 3


def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best segmentation as a digest of its ids, how far the others fall behind, and whether
    it decodes to the text."""
    model = sentencepiece_nbest.read_model(PIECES)
    encoded = sentencepiece_nbest.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), model, N_BEST, verify=True)
    best = F.col("nbest")[0]
    return encoded.select(
        "doc_id",
        F.size(best["ids"]).cast("bigint").alias("n_pieces"),
        best["score"].alias("score"),
        F.size("nbest").cast("bigint").alias("n_segmentations"),
        (best["score"] - F.element_at("nbest", -1)["score"]).alias("margin"),
        F.sha2(F.array_join(best["ids"], " "), 256).alias("ids_sha256"),
        F.col("lossless").alias("round_trip"),
    )


#: The key of the pseudonym query; a user brings an own, secret one.
PSEUDONYM_KEY = "for this query only"


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    changed = pii.pseudonymise(docs, pii.key_from(PSEUDONYM_KEY))
    return changed.select("doc_id", F.coalesce(F.size("pii_spans"), F.lit(0)).cast("bigint").alias("n_found"), F.col("pii_spans").alias("spans"), "text")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"), width=3)


def _judged(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return _judged(toxicity.score_toxicity(docs, model), 4, 2)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_read(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return _judged(quality.score_quality(docs, model), 5, 0)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_kept = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept")
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", n_kept, F.col("kept_text").alias("text"), "n_shared_words")


#: Rules of the url filter's query: `host/path` and what it says.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from all pages, labelled by their own visible text through the quality classifier, which learns from documents."""
    model = quality.fit(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge_urls(pages.select("page_id", "url"), url_filter.text_labels(pages, model), URL_RULES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.group_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(_read(spark, sf_dir, "documents").select("text", "lang"))


#: Words of 2 and 3 by self-joins of the numbered words, what SQL has in place of suffix arrays.
OP11_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(w) AS phrase, 1 AS words FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM words),
counted AS MATERIALIZED (SELECT lang, phrase, words, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE words > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, w, words, f AS a, unnest(range(1, words)) AS k FROM candidates),
halves AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_side, array_to_string(w[k + 1:words], ' ') AS right_side FROM cuts),
parts AS MATERIALIZED (SELECT lang, phrase, f FROM counted WHERE f >= 10),
sides AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000 * c.a * c.a) // (l.f * r.f) AS score FROM halves c
  JOIN parts l ON l.lang = c.lang AND l.phrase = left_side JOIN parts r ON r.lang = c.lang AND r.phrase = right_side),
scored AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE words = 3) GROUP BY ALL),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM scored s LEFT JOIN covered c USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return told.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM hashed),
cut AS (SELECT doc_id, t, n, substr(t, 1, least(c1, c2)) AS p, substr(t, least(c1, c2) + 1, abs(c1 - c2)) AS m, substr(t, greatest(c1, c2) + 1) AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sentencepiece_nbest": op2_sentencepiece_nbest,
        "op3_pii_pseudonyms": op3_pii_pseudonyms,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_mix_sources": op7_mix_sources,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_collocations": op11_collocations,
        "op12_language_id": op12_language_id,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict:
    return {"op10_exact_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op13_fill_in_middle": OP13_SQL}

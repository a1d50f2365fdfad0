"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, langid, maintext, neardup, packing, phrases, pii, spelling, suffixes, toxicity, unigram, wavelet
from .common import shared_folder, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their shingles of three words; null texts have none and link with nothing, rows without an id are left out, repeated rows of an id count once, an empty table gives no rows."""
    return neardup.link_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that start elsewhere too; null texts are empty, repeated rows are documents of their own, an empty table gives no rows."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors by cosine; null, zero and non-finite vectors and rows without an id link with nothing, repeated rows are vectors of their own, an empty table gives no rows."""
    return embeddings.near_copies(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; a null text is its end token alone, repeated rows are packed each, equal plans go by the pieces' order, an empty table gives no rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum as read back from the files; a null text is its end token alone, repeated rows are written each, an empty table gives no rows."""
    return wavelet.encode_documents(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; a null text has none, every row gives a row, of overlapping finds of a kind the leftmost counts, an empty table gives no rows."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; null texts and those without a letter are `und` with score 0, repeated rows get equal answers, of equally short codes the first language by name counts, an empty table gives no rows."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the best segmentation of every text; a null text has none, ties go by the tokenizer's rule, every row gives a row, an empty table gives no rows."""
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, and how similar; null texts and items have none, repeated rows of an item count once, an empty table on either side gives no rows."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents by the chain learned from the labels; null texts are never toxic, documents without a label are scored like any, no labels or an empty table give no rows."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best collocations over all documents; null texts are empty, null languages `und`, an empty table gives no rows."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of all documents; null texts have no words, repeated rows count each, an empty table gives no rows."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; a null html gives an empty text, every row one row, an empty table none."""
    return maintext.extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_embedding_near_dedup, op4_best_fit_packing, op5_token_id_output, op6_personal_data, op7_language_id, op8_token_counts, op9_benchmark_decontamination, op10_toxicity, op11_phrase_collocations, op12_spelling_variants, op13_main_text, pipeline)}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), reach AS (
  SELECT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, coalesce(min(reach.r), d.doc_id) AS component_id
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN sizes z USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
""",
    "op11_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), runs AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM runs, (SELECT unnest([1, 2, 3, 4]) AS m)
), f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
subs AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, s, unnest(range(1, m - s + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL
), kept AS (SELECT c.* FROM c LEFT JOIN subs USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score, k
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL
), own AS (SELECT run, count(*) AS times, hex(encode(d || ':' || run)) AS x FROM runs GROUP BY d, run),
sums AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM own, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(times)::BIGINT AS n
  FROM sums GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
open AS (SELECT word, n, i, word[1:i] AS p, word[i + 2:] AS s FROM places),
less AS (SELECT DISTINCT word, n, p || s AS d FROM open),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM open a JOIN open b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION ALL SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.d = w.word
  UNION ALL SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.d = w.word
), best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) = 1),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM ways w JOIN forms last ON last.word = w.root AND last.form IS NULL JOIN forms f ON f.word = w.word
""",
}

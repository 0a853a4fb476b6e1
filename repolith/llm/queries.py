"""The operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import ann, base, collocations, decontaminate, lexical, line_chunks, mixing, ngram_join, phrase_dedup, pii, quality, suffix_dedup, token_codes, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(base.prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_codes")
def _token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as addressable codes and read back."""
    return token_codes.encode_documents(base.table(spark, sf_dir, "documents"), vocabulary())


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), needs AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS left_size,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM sources
  WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, 3 * source_size * left_weight < weight * left_size AS stops FROM needs
), level AS (
  SELECT left_size, left_weight FROM stopped WHERE NOT stops ORDER BY left_weight DESC LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE
              ELSE (weight * level.left_size)::DOUBLE / level.left_weight::DOUBLE END AS target
  FROM stopped, level
), placed AS (
  SELECT s.doc_id, s.size::BIGINT AS size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0
             ELSE (floor(target)::BIGINT // source_size) * size
                  + least(size, greatest(0, floor(target)::BIGINT % source_size - ahead)) END)::BIGINT AS taken
FROM placed
"""


@query("op2_mixing", MIX_SQL)
def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    plan = mixing.mix_plan(base.table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents
), marked AS (
  SELECT *, CASE WHEN i >= 2 AND contains('{line_chunks.BOUNDARY}', left(md5(lag(md5(line), 2) OVER w || lag(md5(line), 1) OVER w), 1)) THEN 1 ELSE 0 END AS starts
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM marked
), chunks AS (
  SELECT doc_id, pos, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, pos
), judged AS (
  SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY chunk, n_lines >= 2 ORDER BY doc_id, pos) > 1 AS goes FROM chunks
)
SELECT d.doc_id, coalesce(sum(n_lines), 0)::BIGINT AS n_lines,
       coalesce(sum(CASE WHEN goes THEN n_lines ELSE 0 END), 0)::BIGINT AS n_removed,
       count(CASE WHEN goes THEN 1 END)::BIGINT AS chunks_removed,
       sha256(coalesce(string_agg(CASE WHEN NOT goes THEN chunk END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM documents d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id
"""


@query("op9_line_chunks", LINES_SQL)
def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without multi-line chunks that occur before."""
    found = line_chunks.remove_repeated_chunks(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "chunks_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query("op5_pii")
def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.find_personal_data(base.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op7_suffix_dedup")
def _suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without 400-byte strings that start elsewhere too."""
    found = suffix_dedup.remove_repeated_bytes(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op10_phrase_dedup")
def _phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without 35-word windows that start elsewhere too."""
    found = phrase_dedup.remove_repeated_phrases(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_ngram_join")
def _ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 of 100 four-word shingles."""
    found = ngram_join.similar_documents(base.table(spark, sf_dir, "documents"), percent=85, n=4)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op3_ann")
def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth vector."""
    return ann.search(base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op8_decontamination")
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return decontaminate.contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


@query("op6_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity per character of all documents under trusted text, and which stay."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = quality.judge(docs, base.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", F.exp("_entropy").alias("perplexity"), F.exp("_threshold").alias("threshold"), F.col("_keep").alias("keep"))


PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), counts AS (
  SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS f
  FROM places, (VALUES (1), (2), (3)) sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), longer AS (
  SELECT lang, words[2:] AS part, f FROM counts WHERE k = 3 AND f >= 10
  UNION ALL SELECT lang, words[:2], f FROM counts WHERE k = 3 AND f >= 10
), held AS (
  SELECT lang, part, max(f) AS most FROM longer GROUP BY ALL
), kept AS (
  SELECT c.* FROM counts c LEFT JOIN held h ON c.lang = h.lang AND c.words = h.part
  WHERE c.k >= 2 AND c.f >= 10 AND (h.most IS NULL OR 100 * h.most < 50 * c.f)
), cuts AS (
  SELECT c.lang, array_to_string(c.words, ' ') AS phrase, c.f AS a, j, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept c JOIN (VALUES (1), (2)) cut(j) ON j < c.k
  JOIN counts l ON l.lang = c.lang AND l.words = c.words[1:j]
  JOIN counts r ON r.lang = c.lang AND r.words = c.words[j + 1:]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of two and three words of every language."""
    return collocations.collocations(base.table(spark, sf_dir, "documents"))


COPIES_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM good
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least_id AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
), counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.v, vec_id)) AS component_id,
       least(vec_id, coalesce(l.v, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counts c ON c.u = vec_id LEFT JOIN least_id l ON l.u = vec_id
"""


@query("op12_vector_dedup", COPIES_SQL)
def _vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors."""
    return vector_dedup.near_copies(base.table(spark, sf_dir, "embeddings"))


SEARCH_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts
), sizes AS (
  SELECT row, count(*) AS n FROM terms GROUP BY row
), total AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes
), held AS (
  SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, big_n
), shares AS (
  SELECT item_id, doc_id, row, times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS share
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (row), total
), scores AS (
  SELECT item_id, doc_id, row, sum(share)::BIGINT AS score FROM shares GROUP BY ALL HAVING sum(share) > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row)::INTEGER AS rank FROM scores
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_lexical", SEARCH_SQL)
def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item."""
    return lexical.rank_documents(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))

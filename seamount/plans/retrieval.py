"""Queries of analysis, indexing, ranking, result handling, the link graph and activity, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamount.functions import text as T
from seamount.operators import activity, graph
from seamount.operators import index as I
from seamount.operators import rank as R
from seamount.operators import results as O
from seamount.operators.reduced import lsa_ranked
from seamount.sources import collections as C
from seamount.sources import files
from seamount.sources import pages as page_parts
from seamount.sources.shared import keep
from seamount.streaming import activity as streams

from . import fixtures as X
from .evaluation import Query, rounded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _n(c: Column) -> Column:
    return F.size(c).cast("bigint")


# Analysis

TOKENS = f"SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{X.WORD}') AS w FROM documents"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_terms FROM ({TOKENS})")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.tokenized(spark, sf).select("doc_id", _n(F.col("words")).alias("n_tokens"), _n(F.array_distinct("words")).alias("n_terms"))


def _digest(words: Column, joint: str = " ") -> list[Column]:
    return [_n(words).alias("n"), F.md5(F.array_join(words, joint)).alias("digest")]


@query(f"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, list_filter(w, lambda x : NOT list_contains({STOP}, x)) AS k FROM ({TOKENS}))")
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.documents(spark, sf).select("doc_id", *_digest(T.analyze("text", stop=True)))


@query(f"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, list_filter(w, lambda x : regexp_matches(x, '^\\p{{L}}+$') AND NOT list_contains({STOP}, x)) AS k FROM ({TOKENS}))")
def alphabetic_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.documents(spark, sf).select("doc_id", *_digest(T.without_stop_words(T.alphabetic(T.tokens("text")))))


_LEMMA = r"""CASE WHEN regexp_matches(x, '[^aeiou]ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '(ss|x|ch|sh|z)es$') THEN regexp_replace(x, 'es$', '')
WHEN regexp_matches(x, '(ss|us|is)$') OR length(x) < 4 THEN x WHEN regexp_matches(x, 's$') THEN regexp_replace(x, 's$', '') ELSE x END"""


@query(f"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, list_transform(w, lambda x : {_LEMMA}) AS k FROM ({TOKENS}))")
def lemmatized(spark: SparkSession, sf: str) -> DataFrame:
    return X.documents(spark, sf).select("doc_id", *_digest(T.analyze("text", lemmatize=True)))


def _stem_sql() -> str:
    """The steps of the stemmer as a chain of lists in DuckDB; doubled letters are compared, not matched, and a mark keeps short words."""
    def chain(rules, measure, also=None):
        return "CASE " + " ".join(f"WHEN ends_with(x, '{a}') THEN CASE WHEN regexp_matches(left(x, -{len(a)}), '{measure}'){also(a) if also else ''} THEN left(x, -{len(a)}) || '{b}' ELSE x END" for a, b in rules) + " ELSE x END"

    cut = lambda a: f"WHEN ends_with(x, '{a}') THEN CASE WHEN regexp_matches(left(x, -{len(a)}), '{T.HAS_VOWEL}') THEN left(x, -{len(a)}) || chr(1) ELSE x END"
    first = "CASE WHEN starts_with(x, 'y') THEN 'Y' || substr(x, 2) ELSE x END"
    steps = (
        f"CASE WHEN length(x) <= 2 THEN x || chr(2) WHEN regexp_matches(x, '(?:ss|i)es$') AND length(x) > 3 THEN left({first}, -2) WHEN regexp_matches(x, '[^s]s$') THEN left({first}, -1) ELSE {first} END",
        f"CASE WHEN ends_with(x, 'eed') THEN CASE WHEN regexp_matches(left(x, -3), '{T.MEASURE_0}') THEN left(x, -1) ELSE x END {cut('ed')} {cut('ing')} ELSE x END",
        f"CASE WHEN NOT ends_with(x, chr(1)) THEN x WHEN regexp_matches(left(x, -1), '(?:at|bl|iz)$') OR regexp_matches(left(x, -1), '{T.SHORT}') THEN left(x, -1) || 'e' "
        "WHEN length(x) > 2 AND substr(x, -2, 1) = substr(x, -3, 1) AND NOT contains('aeiouylsz', substr(x, -2, 1)) THEN left(x, -2) ELSE left(x, -1) END",
        f"CASE WHEN ends_with(x, 'y') AND regexp_matches(left(x, -1), '{T.HAS_VOWEL}') THEN left(x, -1) || 'i' ELSE x END",
        chain(T.STEP_2, T.MEASURE_0),
        chain(T.STEP_3, T.MEASURE_0),
        chain([(a, "") for a in T.STEP_4], T.MEASURE_1, lambda a: " AND regexp_matches(left(x, -3), '[st]$')" if a == "ion" else ""),
        f"CASE WHEN ends_with(x, 'e') AND (regexp_matches(left(x, -1), '{T.MEASURE_1}') OR regexp_matches(left(x, -1), '{T.EXACTLY_1}') AND NOT regexp_matches(left(x, -1), '{T.SHORT}')) THEN left(x, -1) ELSE x END",
        f"CASE WHEN ends_with(x, 'll') AND regexp_matches(x, '{T.MEASURE_1}') THEN left(x, -1) ELSE x END",
    )
    out = "w"
    for step in steps:
        out = f"list_transform({out}, lambda x : {step})"
    return f"list_transform({out}, lambda x : replace(CASE WHEN starts_with(x, 'Y') THEN 'y' || substr(x, 2) ELSE x END, chr(2), ''))"


@query(f"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {_stem_sql()} AS k FROM ({TOKENS}))")
def stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_stems(X.tokenized(spark, sf)).select("doc_id", *_digest(F.col("words")))


@query(f"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, '|')) AS digest FROM (SELECT doc_id, list_transform(range(1, greatest(len(w), 1)), lambda i : w[i] || ' ' || w[i + 1]) AS k FROM ({TOKENS}))")
def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return X.documents(spark, sf).select("doc_id", *_digest(T.ngrams(T.tokens("text"), 2), "|"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s : trim(s, ' ')), lambda s : s <> '')"


@query(f"SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_max(list_transform(s, lambda x : length(x))), 0)::BIGINT AS longest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = X.documents(spark, sf).select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", _n(F.col("s")).alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"))


@query(r"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, '|')) AS digest FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(?:\p{Lu}\p{Ll}+ ?){2,}'), lambda x : trim(x, ' ')) AS k FROM documents)")
def named_entities(spark: SparkSession, sf: str) -> DataFrame:
    return X.documents(spark, sf).select("doc_id", *_digest(T.entities("text"), "|"))


@query("SELECT doc_id, md5(coalesce(source, '') || ':' || doc_id) AS digest, concat_ws(' ', lang, source, n_chars::VARCHAR) AS combined FROM documents")
def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", T.document_digest(F.concat_ws(":", F.coalesce("source", F.lit("")), "doc_id")).alias("digest"), T.combined("lang", "source", F.col("n_chars").cast("string")).alias("combined"))


@query("""WITH s AS (SELECT p_type, list_slice(list_sort(list_distinct(list(string_split(p_name, ' ')[1]))), 1, 3) AS s FROM part GROUP BY p_type)
SELECT p_type AS word, '(' || p_type || ' ' || array_to_string(s, ' ') || ')' AS expanded FROM s""")
def synonym_expansion(spark: SparkSession, sf: str) -> DataFrame:
    words = C.table(spark, sf, "part").groupBy("p_type").agg(F.collect_set(F.split("p_name", " ")[0]).alias("s"))
    return words.select(F.col("p_type").alias("word"), T.expansion("p_type", "s").alias("expanded"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e),
s AS (SELECT q.vec_id AS word, d.vec_id AS synonym, round(list_inner_product(q.v, d.v) / (q.n * d.n), 4) + 0 AS cosine FROM n q JOIN n d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cosine DESC, synonym) AS rank FROM s WHERE cosine > 0.3)
SELECT word, synonym, cosine, rank FROM r WHERE rank <= 3""")
def vector_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    e = C.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return R.vector_neighbours(e.where("vec_id % 50 = 0"), e, least=0.3, k=3).select("word", "synonym", "cosine", F.col("rank").cast("bigint").alias("rank"))


# Index


@query(f"WITH {X.CORPUS} SELECT term, df::BIGINT AS df, cf::BIGINT AS cf FROM stats")
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.build(X.documents(spark, sf))["term_stats"]


@query(f"WITH {X.CORPUS} SELECT doc_id, len FROM lens")
def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return I.build(X.documents(spark, sf))["doc_stats"]


@query(f"WITH {X.CORPUS} SELECT n_docs::BIGINT AS n_docs, total_terms::BIGINT AS total_terms, round(avgdl, 6) AS avgdl FROM coll")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.build(X.documents(spark, sf))["corpus_stats"])


# Ranking


def _top(found: DataFrame) -> DataFrame:
    return rounded(found.select("qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank")))


def _top_sql(scores: str, k: int = 10) -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ({scores})), top AS (SELECT qid, doc_id, score, rank FROM r WHERE rank <= {k})"


BM25 = """SELECT t.qid, p.doc_id, round(sum(t.qtf * ln((c.n_docs - s.df + 0.5::DOUBLE) / (s.df + 0.5::DOUBLE) + 1) * (p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / c.avgdl)))), 6) AS score
FROM terms t JOIN posts p ON t.term = p.term JOIN stats s ON s.term = t.term JOIN lens l ON l.doc_id = p.doc_id, coll c GROUP BY t.qid, p.doc_id"""


def _bm25(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return _top(R.bm25_top(X.tokenized(spark, sf), X.terms(spark, sf), k))


@query(f"WITH {X.CORPUS}, {_top_sql(f'SELECT * FROM ({BM25}) WHERE score > 0')} SELECT * FROM top")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


_OKAPI = """SELECT t.qid, p.doc_id, round(sum(t.qtf * CASE WHEN s.idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM idfs) ELSE s.idf END * (p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / c.avgdl)))), 6) AS score
FROM terms t JOIN posts p ON t.term = p.term JOIN idfs s ON s.term = t.term JOIN lens l ON l.doc_id = p.doc_id, coll c GROUP BY t.qid, p.doc_id"""
_IDFS = "idfs AS (SELECT term, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM stats, coll)"


@query(f"WITH {X.CORPUS}, {_IDFS}, {_top_sql(_OKAPI)} SELECT * FROM top")
def bm25_okapi_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(R.bm25_okapi_top(X.written(spark, sf), X.terms(spark, sf), 10))


def _lm(spark: SparkSession, sf: str, smoothing: str, k: int = 10) -> DataFrame:
    words = X.written(spark, sf) if smoothing == "dirichlet" else X.tokenized(spark, sf)  # the vocabulary is counted too
    return _top(R.language_model_top(words, X.terms(spark, sf), k, smoothing))


_KNOWN = "known AS (SELECT t.*, s.cf, c.total_terms, c.vocab FROM terms t LEFT JOIN stats s ON t.term = s.term, coll c)"
_EVERY = "every AS (SELECT k.qid, l.doc_id, l.len, k.term, k.qtf, k.cf, k.total_terms, k.vocab, coalesce(p.tf, 0) AS tf FROM known k JOIN lens l ON true LEFT JOIN posts p ON p.doc_id = l.doc_id AND p.term = k.term)"
_DIRICHLET = "SELECT qid, doc_id, round(sum(qtf * ln((tf + 1000::DOUBLE * coalesce(cf / total_terms::DOUBLE, 0.2::DOUBLE / vocab)) / (len + 1000))), 6) AS score FROM every GROUP BY qid, doc_id"
_JM = "SELECT qid, doc_id, round(sum(qtf * ln(greatest(0.8::DOUBLE * tf / (len + 1e-10) + 0.2::DOUBLE * coalesce(cf / total_terms::DOUBLE, 0), 1e-10))), 6) AS score FROM every GROUP BY qid, doc_id"


@query(f"WITH {X.CORPUS}, {_KNOWN}, {_EVERY}, {_top_sql(_DIRICHLET)} SELECT * FROM top")
def lm_dirichlet_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _lm(spark, sf, "dirichlet")


@query(f"WITH {X.CORPUS}, {_KNOWN}, {_EVERY}, {_top_sql(_JM)} SELECT * FROM top")
def lm_jm_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _lm(spark, sf, "jm")


@query(f"""WITH {X.CORPUS}, {_KNOWN} SELECT qid, round(-sum(qtf * log2(0.2::DOUBLE / vocab + 0.8::DOUBLE * coalesce(cf / total_terms::DOUBLE, 0))) / sum(qtf), 6) AS entropy,
round(sum(CASE WHEN cf IS NOT NULL THEN qtf ELSE 0 END)::DOUBLE / sum(qtf), 6) AS coverage FROM known GROUP BY qid""")
def lm_entropy_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.entropy_and_coverage(X.written(spark, sf), X.terms(spark, sf)))


_ROWS = rf"""
sents AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS s FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
rws AS (SELECT doc_id || ':' || pos AS row_id, doc_id, list_filter(regexp_extract_all(lower(s), '{X.WORD}'), lambda x : NOT list_contains({STOP}, x) AND length(x) >= 2) AS w FROM sents),
num AS (SELECT count(*) AS n FROM rws),
tf AS (SELECT row_id, doc_id, term, count(*) AS tf FROM (SELECT row_id, doc_id, unnest(w) AS term FROM rws) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT row_id, doc_id, tf.term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term, num),
wts AS (SELECT row_id, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM raw),
tdw AS (SELECT term, sqrt(greatest(sum(w * w) / n - pow(sum(w) / n, 2), 0)) AS tdw FROM wts, num GROUP BY term, n)"""


@query(f"WITH {_ROWS} SELECT term, count(*)::BIGINT AS n_rows, round(sum(w), 5) AS weight FROM wts GROUP BY term")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = R.term_weights(R.sentence_rows(X.documents(spark, sf)))
    return rounded(w.select("term", F.col("df").alias("n_rows"), F.col("s").alias("weight")), 5)


@query(f"WITH {_ROWS} SELECT term, round(tdw, 6) AS tdw FROM tdw")
def term_discrimination(spark: SparkSession, sf: str) -> DataFrame:
    w = R.term_weights(R.sentence_rows(X.documents(spark, sf)))
    return rounded(w.select("term", R.deviation().alias("tdw")))


_EVSM = f"""SELECT qid, doc_id, score FROM (SELECT qid, doc_id, round(max(dot / (en * qn)), 6) AS score FROM (
SELECT q.qid, e.doc_id, e.row_id, any_value(e.en) AS en, any_value(q.qn) AS qn, sum(q.qw * e.ew) AS dot
FROM (SELECT *, sqrt(sum(qw * qw) OVER (PARTITION BY qid)) AS qn FROM (SELECT v.qid, v.term, v.w * tdw AS qw FROM (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM
       (SELECT t.qid, t.term, (1 + ln(qtf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM terms t JOIN df ON t.term = df.term, num)) v JOIN tdw ON v.term = tdw.term)) q
JOIN (SELECT *, sqrt(sum(ew * ew) OVER (PARTITION BY row_id)) AS en FROM (SELECT row_id, doc_id, wts.term, w * tdw AS ew FROM wts JOIN tdw ON wts.term = tdw.term)) e ON q.term = e.term
GROUP BY q.qid, e.doc_id, e.row_id) WHERE en * qn > 0 GROUP BY qid, doc_id) WHERE score > 0"""


def _evsm(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return _top(R.evsm_top(R.sentence_rows(X.documents(spark, sf)), X.terms(spark, sf), k))


@query(f"WITH {X.CORPUS}, {_ROWS}, {_top_sql(_EVSM)} SELECT * FROM top")
def evsm_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _evsm(spark, sf)


@query(None)  # singular vectors
def lsa_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(R.top(lsa_ranked(R.sentence_rows(X.documents(spark, sf)), X.terms(spark, sf)), 10))


# Results


@query(f"""WITH {X.CORPUS}, {_KNOWN}, {_EVERY}, {_ROWS}, a AS (WITH {_top_sql(_EVSM)} SELECT * FROM top), b AS (WITH {_top_sql(f'SELECT * FROM ({BM25}) WHERE score > 0')} SELECT * FROM top), d AS (WITH {_top_sql(_JM)} SELECT * FROM top),
f AS (SELECT coalesce(a.qid, b.qid, d.qid) AS qid, coalesce(a.doc_id, b.doc_id, d.doc_id) AS doc_id, a.score AS s0, b.score AS s1, d.score AS s2, a.rank AS r0, b.rank AS r1, d.rank AS r2
      FROM a FULL JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id FULL JOIN d ON coalesce(a.qid, b.qid) = d.qid AND coalesce(a.doc_id, b.doc_id) = d.doc_id)
SELECT qid, doc_id, coalesce(s0, 0) AS vsm_score, coalesce(s1, 0) AS bm25_score, coalesce(s2, 0) AS lm_score,
row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN r0 IS NOT NULL THEN 0 WHEN r1 IS NOT NULL THEN 1 ELSE 2 END, coalesce(r0, r1, r2)) AS position FROM f""")
def fuse_outer(spark: SparkSession, sf: str) -> DataFrame:
    lists = [_evsm(spark, sf), _bm25(spark, sf), _lm(spark, sf, "jm")]
    return rounded(O.fuse(*lists).withColumn("position", F.col("position").cast("bigint")))


_BM25_100 = f"WITH {X.CORPUS}, {_top_sql(f'SELECT * FROM ({BM25}) WHERE score > 0', 100)}"


@query(f"""{_BM25_100}, n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS total FROM top)
SELECT qid, doc_id, score, rank, true AS has_previous_page, total > 30 AS has_next_page, ceil(total / 15.0)::BIGINT AS pages FROM n WHERE rank BETWEEN 16 AND 30""")
def page_window(spark: SparkSession, sf: str) -> DataFrame:
    return O.page(_bm25(spark, sf, 100), 2, 15)


@query("""SELECT user_id, n // 20 + 1 AS number, ceil(n / 20.0)::BIGINT AS pages, list_aggregate([x FOR x IN range(1, 1000) IF x BETWEEN n // 20 + 1 - 5 AND n // 20 + 1 + 5 AND x <= ceil(n / 20.0)], 'string_agg', ' ') AS links
FROM (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id)""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """The pages that the page with the last event of each user links to, 20 events to a page."""
    n = C.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    n = n.select("user_id", F.floor(F.col("n") / 20 + 1).cast("bigint").alias("number"), F.ceil(F.col("n") / 20).cast("bigint").alias("pages"))
    links = O.page_links(F.col("number"), F.col("pages"))
    return n.withColumn("links", F.nullif(F.array_join(links, " "), F.lit("")))


@query(rf"""WITH {X.CORPUS}, {_top_sql(f'SELECT * FROM ({BM25}) WHERE score > 0')}, q AS (SELECT qid, list(term) AS t FROM terms GROUP BY qid),
s AS (SELECT top.qid, top.doc_id, q.t, string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ') AS w FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN q ON q.qid = top.qid),
i AS (SELECT *, list_filter(range(1, len(w) + 1), lambda j : list_contains(t, lower(w[j])))[1] AS i FROM s)
SELECT qid, doc_id, CASE WHEN i IS NULL THEN 'No relevant snippet found.' ELSE array_to_string(w[greatest(i - 15, 1) : least(i + 15, len(w) + 1) - 1], ' ') || CASE WHEN least(i + 15, len(w) + 1) <= len(w) THEN '...' ELSE '' END END AS snippet FROM i""")
def result_snippets(spark: SparkSession, sf: str) -> DataFrame:
    words = X.terms(spark, sf).groupBy("qid").agg(F.collect_set("term").alias("t"))  # of one query
    found = keep(_bm25(spark, sf), "found")
    found = X.documents(spark, sf).join(I.small(found), "doc_id").join(I.small(words), "qid")
    return found.select("qid", "doc_id", T.snippet("text", "t").alias("snippet"))


@query(f"{_BM25_100} SELECT qid, rank, qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || score || ' STANDARD' AS line FROM top")
def run_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    top = _bm25(spark, sf, 100).select("qid", F.col("doc_id").cast("string").alias("docno"), "rank", F.col("score").alias("sim"))
    return files.run_lines(top)


# Image search: parts as images with a text, a size, colors, categories and objects


def images(spark: SparkSession, sf: str) -> DataFrame:
    part = C.table(spark, sf, "part")
    return part.select(
        F.concat(F.lit("http://img/"), "p_partkey").alias("image_url"),
        F.struct((F.col("p_size") * 12).cast("bigint").alias("w"), (F.col("p_partkey") % 700).alias("h")).alias("image_size"),
        F.array(T.color_of(F.substring(F.md5("p_brand"), 1, 6)), T.color_of(F.substring(F.md5("p_name"), 1, 6))).alias("dominant_colors"),
        F.split("p_name", " ").alias("detected_objects"),
        F.array("p_type", "p_brand").alias("categories"),
    )


_CODE = "list_transform([1, 3, 5], lambda i : ('0x' || substr({0}, i, 2))::INT)"
IMAGES = f"""
img AS (SELECT 'http://img/' || p_partkey AS image_url, p_size::BIGINT * 12 AS w, p_partkey % 700 AS h, [{_CODE.format('md5(p_brand)')}, {_CODE.format('md5(p_name)')}] AS colors, string_split(p_name, ' ') AS objects, [p_type, p_brand] AS categories FROM part)"""


def _image_scores(spark: SparkSession, sf: str) -> DataFrame:
    part = C.table(spark, sf, "part")
    words = T.tokens(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    docs = part.select(F.concat(F.lit("http://img/"), "p_partkey").alias("doc_id"), words.alias("words"))
    asked = spark.createDataFrame([("red widget",), ("small bolt",)], "qid string")
    scores = R.bm25_okapi(docs, I.query_terms(asked.select("qid", F.col("qid").alias("text"))))
    return scores.select("qid", F.col("doc_id").alias("image_url"), "score")


IMAGE_SCORES = f"""
docs AS (SELECT 'http://img/' || p_partkey AS doc_id, regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_type)), '{X.WORD}') AS words FROM part),
lens AS (SELECT doc_id, len(words)::BIGINT AS len FROM docs),
posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY doc_id, term),
stats AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
coll AS (SELECT count(*) AS n_docs, sum(len)::DOUBLE / count(*) AS avgdl FROM lens),
terms AS (SELECT qid, unnest(string_split(qid, ' ')) AS term, 1 AS qtf FROM (VALUES ('red widget'), ('small bolt')) v(qid)), {_IDFS},
sc AS ({_OKAPI})"""
_NORMAL = "norm AS (SELECT qid, doc_id AS image_url, score, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) AS normalized FROM sc WINDOW w AS (PARTITION BY qid))"


@query(f"WITH {IMAGE_SCORES}, {_NORMAL} SELECT qid, image_url, score, round(normalized, 6) AS normalized FROM norm")
def minmax_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.minmax(_image_scores(spark, sf)))


_BOOSTED = f"{_NORMAL}, bst AS (SELECT n.*, img.* EXCLUDE (image_url), normalized + 3.0::DOUBLE * len(list_filter(['red', 'widget'], lambda x : list_contains(objects, x))) AS final FROM norm n JOIN img ON n.image_url = img.image_url WHERE normalized >= 0.25)"


def _image_query(where: str, **filters):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        rows = O.image_results(_image_scores(spark, sf), images(spark, sf), ["red", "widget"], **filters)
        return rounded(rows.select("qid", "image_url", F.col("final").alias("score"), F.col("rank").cast("bigint").alias("rank")))

    return f, f"WITH {IMAGES}, {IMAGE_SCORES}, {_BOOSTED} SELECT qid, image_url, round(final, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY final DESC, image_url) AS rank FROM bst WHERE {where}"


for _name, _where, _filters in (
    ("object_boost", "true", {}),
    ("size_filter", "w BETWEEN 101 AND 500 AND h BETWEEN 101 AND 500", {"band": "medium"}),
    ("color_filter", "len(list_filter(colors, lambda c : abs(c[1] - 128) <= 100 AND abs(c[2] - 60) <= 100 AND abs(c[3] - 200) <= 100)) > 0", {"rgb": (128, 60, 200)}),
    ("category_filter", "list_contains(categories, 'ECONOMY')", {"category": "ECONOMY"}),
):
    QUERIES[_name], SQL[_name] = _image_query(_where, **_filters)


@query(f"WITH {IMAGES}, {IMAGE_SCORES}, {_BOOSTED} SELECT category, count(*)::BIGINT AS n FROM (SELECT unnest(categories) AS category FROM bst) GROUP BY category")
def category_facets(spark: SparkSession, sf: str) -> DataFrame:
    return O.facets(O.image_results(_image_scores(spark, sf), images(spark, sf), []))


@query("""SELECT p_type, p_brand, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand)) WHERE rank <= 3""")
def dominant_values(spark: SparkSession, sf: str) -> DataFrame:
    return O.dominant(C.table(spark, sf, "part"), ["p_type"], "p_brand").select("p_type", "p_brand", "n", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {IMAGES} SELECT image_url, list_transform(colors, lambda c : printf('#%02x%02x%02x', c[1], c[2], c[3])) AS codes FROM img".replace("AS codes", "[1] AS code"))
def hex_colors(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).select("image_url", T.hex_color(F.col("dominant_colors")[0]).alias("code"))


_FIGURE = "'<h1 id=\"firstHeading\"> Page ' || page_id || '</h1><div id=\"bodyContent\"><p>before ' || page_id || '</p><figure><a href=\"/f\"><img src=\"/i/' || page_id || '.png\" alt=\"a&amp;b\"></a><figcaption> The ' || page_id || '</figcaption></figure><p>behind</p>'"


@query(f"""SELECT url AS page_url, 'Page ' || page_id AS page_title, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/i/' || page_id || '.png' AS image_url, 'a&b' AS alt_text, 'before ' || page_id || ' behind' AS surrounding_text, 'The ' || page_id AS caption,
contains(html, '<p>') AS long FROM pages""")
def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """The image of a figure that is put before each page's own markup, in the element that holds an article."""
    pages = C.table(spark, sf, "pages").select("url", F.concat(F.expr(_FIGURE), F.coalesce("html", F.lit("")), F.lit("</div>")).alias("html"))
    found = page_parts.page_images(pages)
    return found.select("page_url", "page_title", "image_url", "alt_text", "surrounding_text", "caption", (F.length("body_text") > 40).alias("long"))


@query(f"SELECT image_url, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS digest FROM (WITH {IMAGES} SELECT image_url, regexp_extract_all(lower(image_url || ' ' || array_to_string(objects, ' ')), '[\\p{{L}}\\p{{N}}]+') AS k FROM img)")
def labelled_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of texts with the labels of what was detected in the image."""
    return images(spark, sf).select("image_url", *_digest(T.tokens(T.with_labels("image_url", "detected_objects"))))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def last_written(spark: SparkSession, sf: str) -> DataFrame:
    return O.last_by(C.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_type", "value")


# Collections, links and activity


@query(r"""SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS title, coalesce(source, '') AS author, '' AS bib, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def markup_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as markup, one to a file, and parsed again; one without a text has no such element."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = ["<doc><docno> ", F.col("doc_id").cast("string"), " </docno><title>", F.coalesce("lang", F.lit("")), "</title><author>", F.coalesce("source", F.lit("")), "</author><bib/>", F.coalesce(F.concat(F.lit("<text>"), safe, F.lit("</text>")), F.lit("")), "</doc>"]
    value = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    found = C.parse_documents(C.table(spark, sf, "documents").select(value.alias("value")))
    return found.select("doc_id", "title", "author", "bib", F.md5("text").alias("digest"))


LINKS = r"""
found AS (SELECT page_id, url AS src, unnest(regexp_extract_all(coalesce(html, ''), '<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages),
parts AS (SELECT *, trim(href, ' ') AS h, regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) AS scheme, regexp_replace(src, '[?#].*$', '') AS bare, regexp_replace(src, '#.*$', '') AS whole FROM found),
paths AS (SELECT *, regexp_extract(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$', 1) AS path FROM parts),
links AS (SELECT page_id, src, href, regexp_replace(CASE WHEN h = '' THEN whole WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN scheme || h WHEN h LIKE '/%' THEN origin || h
  WHEN h LIKE '?%' THEN bare || h WHEN h LIKE '#%' THEN whole || h ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || h END, '/\./', '/', 'g') AS url FROM paths)"""


@query(f"WITH {LINKS} SELECT page_id, src, href, url FROM links")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return graph.links(C.table(spark, sf, "pages"))


@query(f"WITH {LINKS} SELECT url, count(*)::BIGINT AS n FROM links WHERE url LIKE 'https://%' AND NOT contains(href, ':') AND NOT contains(href, '#') GROUP BY url")
def followed_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.links(C.table(spark, sf, "pages"))
    return rows.where(graph.followed(F.col("href"), F.col("url"), "https://")).groupBy("url").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    item = C.table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    return item.select(F.col("p").alias("src"), F.col("s").alias("dst")).union(item.select("s", "p"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)),
b(url, depth) AS (SELECT 's0', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.url = e.src WHERE b.depth < 2),
m AS (SELECT url, min(depth) AS depth FROM b GROUP BY url)
SELECT m.url, m.depth::INT AS depth, count(e.src)::BIGINT AS visit_count FROM m LEFT JOIN e ON e.dst = m.url GROUP BY m.url, m.depth""")
def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("s0",)], "url string")
    return graph.breadth_first(_edges(spark, sf), seeds, max_depth=2, max_pages=None)


def _clicks(events: DataFrame) -> DataFrame:
    clicks = events.where("event_type IN ('view', 'click')")
    return clicks.select(F.col("user_id").alias("query"), F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"))


_CLICKS = """SELECT user_id AS query, json_extract_string(props, '$.k')::BIGINT AS doc_id, count(*)::BIGINT AS views, round(count(*) * 0.1::DOUBLE, 6) AS score_boost
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2"""


@query(_CLICKS)
def interaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activity.interactions(_clicks(C.table(spark, sf, "events")))


@query(_CLICKS)
def stream_interaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts from a stream over the table's files, as of the end of what there is."""
    events = C.table(spark, sf, "events")
    path = f"{sf}/events.parquet"
    found = spark.readStream.schema(events.schema).parquet(path if len(events.inputFiles()) > 1 else f"{sf}/events.parq[u]et")
    return streams.latest(streams.interaction_counts(_clicks(found)))


@query("""SELECT event_id, user_id, k AS doc_id, epoch_us(closed) - epoch_us(ts) AS dwell_us FROM (
SELECT *, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS closed FROM (SELECT event_id, user_id, ts, json_extract_string(props, '$.k')::BIGINT AS k, CASE event_type WHEN 'view' THEN 'open' ELSE 'close' END AS kind
FROM events WHERE event_type IN ('view', 'click')) WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)) WHERE kind = 'open' AND next_kind = 'close'""")
def dwell_time(spark: SparkSession, sf: str) -> DataFrame:
    e = C.table(spark, sf, "events").where("event_type IN ('view', 'click')")
    rows = e.select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"), F.expr("CASE event_type WHEN 'view' THEN 'open' ELSE 'close' END").alias("kind"))
    return activity.dwell(rows)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' user=' || user_id || ' ' || coalesce(props, '') AS line FROM events")
def activity_log(spark: SparkSession, sf: str) -> DataFrame:
    return activity.log_lines(C.table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), F.col("props").alias("about")))

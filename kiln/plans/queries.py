"""The query catalogue: operators applied to the test tables, and the same results in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions import text as tx
from kiln.functions import words
from kiln.operators import boolean, clustered, dense, evaluation, lsa, present, pruned, ranked, report, web
from kiln.operators.index import Index, IndexCatalog, pretty_vectors, tokenise
from kiln.operators.spectral import shared_folder
from kiln.operators.store import Store
from kiln.sources import readers, sinks
from kiln.sources.readers import read_table

K = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def index_of(spark: SparkSession, sf: str) -> Index:
    return Index(documents(spark, sf).select("doc_id", "text"), order_col="doc_id", keep=True)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


# -- SQL of the text pipeline


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(x: str) -> str:
    for a, b in tx.FOLD_WORDS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, {_quoted(tx.FOLD_FROM)}, {_quoted(tx.FOLD_TO)})"


def prepared_sql(x: str) -> str:
    return fold_sql(rf"regexp_replace(replace(replace(coalesce({x}, ''), '\n', ' '), chr(10), ' '), '{tx.TAG}', '', 'g')")


def tokens_sql(x: str) -> str:
    listed = ", ".join(map(_quoted, tx.STOP_WORDS))
    edges = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
    return f"list_filter(list_transform(regexp_extract_all(lower({prepared_sql(x)}), {_quoted(tx.TOKEN)}), lambda t: regexp_replace(t, {_quoted(edges)}, '', 'g')), lambda t: length(t) >= 2 AND t NOT IN ({listed}))"


_TOK = f"tok AS (SELECT doc_id, t FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) WHERE len(t) > 0)"
_TF = f"{_TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)"
_VOCAB = f"{_TF}, vocab AS (SELECT term, count(*) AS df, log10((SELECT count(*) FROM tok)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term)"
_POST = f"{_VOCAB}, post AS (SELECT doc_id, term, (1 + log10(tf)) * idf AS w FROM tf JOIN vocab USING (term) WHERE (1 + log10(tf)) * idf <> 0), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM post GROUP BY doc_id)"
_QV = f"{_POST}, q AS (SELECT qid, term, (1 + log10(count(*))) * any_value(idf) AS qw FROM (SELECT item_id AS qid, unnest({tokens_sql('text')}) AS term FROM qtext) JOIN vocab USING (term) GROUP BY qid, term), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS n FROM q GROUP BY qid)"
_SCORED = f"{_QV}, scored AS (SELECT qid, doc_id, round(sum(qw / qn.n * (w / norm.n)), 6) AS score FROM q JOIN qn USING (qid) JOIN post USING (term) JOIN norm USING (doc_id) WHERE qw <> 0 GROUP BY qid, doc_id)"


def _top_sql(k: int) -> str:
    return (
        f"best AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored QUALIFY rank <= {k}), "
        f"firsts AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id FROM tok QUALIFY rank <= {k}), "
        "run AS (SELECT qid, rank, doc_id, score FROM best UNION ALL SELECT item_id, rank, doc_id, 0.0 FROM (SELECT DISTINCT item_id FROM qtext) CROSS JOIN firsts WHERE item_id NOT IN (SELECT qid FROM best))"
    )


_BENCH = "qtext AS (SELECT item_id, text FROM benchmark)"


def _run_sql(k: int, qtext: str = _BENCH) -> str:
    return f"{qtext}, {_SCORED}, {_top_sql(k)}"


# -- text


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def tokenize(spark, sf):
    return documents(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) WHERE len(t) > 0")
def nonempty_documents(spark, sf):
    return tokenise(documents(spark, sf), order_col="doc_id").select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query(f"SELECT 'basic' AS method, f AS field, term, count(*) AS n FROM (SELECT 'source' AS f, unnest({tokens_sql('source')}) AS term FROM documents UNION ALL SELECT 'text', unnest({tokens_sql('text')}) FROM documents) GROUP BY ALL")
def token_counts_by_field(spark, sf):
    return report.token_frequencies(documents(spark, sf), ("source", "title", "text"), {"basic": tx.TextConfig()})


@query(rf"SELECT doc_id, len(list_filter(regexp_extract_all(lower({prepared_sql('text')}), {_quoted(tx.TOKEN)}), lambda t: t IN ({', '.join(map(_quoted, tx.STOP_WORDS))}))) AS n_stop FROM documents")
def stopword_filter(spark, sf):
    raw = tx.raw_tokens(tx.prepared(F.col("text")))
    return documents(spark, sf).select("doc_id", F.size(F.filter(raw, lambda x: x.isin(tx.STOP_WORDS))).cast("long").alias("n_stop"))


@query(rf"SELECT page_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT page_id, regexp_replace(replace(replace(coalesce(html, ''), '\n', ' '), chr(10), ' '), '{tx.TAG}', '', 'g') AS s FROM pages)")
def strip_tags(spark, sf):
    s = tx.strip_tags(tx.fold_newlines(tx.guard(F.col("html"))))
    return read_table(spark, sf, "pages").select("page_id", F.length(s).cast("long").alias("n_chars"), F.md5(s.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS digest FROM documents")
def ascii_fold(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.ascii_fold(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 OR page_id::VARCHAR IN ('', '0') THEN NULL ELSE page_id::VARCHAR END, CASE WHEN page_id % 2 = 0 THEN nullif(url, '') END, 'doc_' || page_id) AS ident FROM pages")
def doc_identity(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", tx.document_id(F.when(F.col("page_id") % 3 != 0, F.col("page_id")), F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("page_id")).alias("ident"))


@query("SELECT doc_id, md5(concat_ws(' ', nullif(source, ''), CASE WHEN doc_id % 2 = 0 THEN NULL ELSE nullif(lang, '') END, nullif(text, ''))) AS digest FROM documents")
def text_concat(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.md5(tx.joined_text(F.col("source"), F.when(F.col("doc_id") % 2 != 0, F.col("lang")), F.col("text")).cast("binary")).alias("digest"))


_UNITS = "['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def _below_100(n: str) -> str:
    return f"CASE WHEN ({n}) < 20 THEN {_UNITS}[{n}] WHEN ({n}) % 10 = 0 THEN {_TENS}[({n}) // 10] ELSE {_TENS}[({n}) // 10] || '-' || {_UNITS}[({n}) % 10] END"


def _below_1000(n: str) -> str:
    return f"CASE WHEN ({n}) < 100 THEN {_below_100(n)} WHEN ({n}) % 100 = 0 THEN {_UNITS}[({n}) // 100] || ' hundred' ELSE {_UNITS}[({n}) // 100] || ' hundred and ' || {_below_100(f'({n}) % 100')} END"


def number_sql(n: str) -> str:
    """A whole number below a thousand millions in words."""
    groups = f"concat_ws(', ', CASE WHEN {n} >= 1000000 THEN {_below_1000(f'{n} // 1000000')} || ' million' END, CASE WHEN {n} // 1000 % 1000 > 0 THEN {_below_1000(f'{n} // 1000 % 1000')} || ' thousand' END, CASE WHEN {n} % 1000 >= 100 THEN {_below_1000(f'{n} % 1000')} END)"
    return f"CASE WHEN {n} = 0 THEN 'zero' WHEN {n} < 100 THEN {_below_100(n)} ELSE {groups} || CASE WHEN {n} % 1000 BETWEEN 1 AND 99 AND {n} >= 1000 THEN ' and ' || {_below_100(f'{n} % 1000')} ELSE '' END END"


_DAYS = "['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth','twentieth','twenty-first','twenty-second','twenty-third','twenty-fourth','twenty-fifth','twenty-sixth','twenty-seventh','twenty-eighth','twenty-ninth','thirtieth','thirty-first']"
_RULES = "(VALUES ('s', ''), ('ses', 's'), ('ves', 'f'), ('xes', 'x'), ('zes', 'z'), ('ches', 'ch'), ('shes', 'sh'), ('men', 'man'), ('ies', 'y')) AS r(cut, put)"


@query()
def porter_stem(spark, sf):
    return tokenise(documents(spark, sf)).select(F.explode("tokens").alias("token")).distinct().select("token", words.porter(F.col("token")).alias("stem"))


@query(f"WITH {_TOK}, v AS (SELECT DISTINCT unnest(t) AS token FROM tok), tried AS (SELECT token, left(token, length(token) - length(cut)) || put AS form FROM v JOIN {_RULES} ON ends_with(token, cut) WHERE NOT (ends_with(token, 'ss') AND cut = 's')), best AS (SELECT tried.token, arg_min(form, length(form) * 1000 + i) AS form FROM (SELECT *, row_number() OVER (PARTITION BY token, length(form) ORDER BY form) AS i FROM tried WHERE form IN (SELECT token FROM v)) tried GROUP BY tried.token) SELECT v.token, coalesce(form, v.token) AS lemma FROM v LEFT JOIN best ON v.token = best.token")
def lemma(spark, sf):
    none = spark.createDataFrame([], "token string, base string")
    return words.lemmas(tokenise(documents(spark, sf)).select(F.explode("tokens").alias("token")).distinct(), exceptions=none)


@query(f"SELECT o_orderkey, 'ordered ' || lower(monthname(o_orderdate)) || ' ' || {_DAYS}[day(o_orderdate)] || ' ' || {number_sql('year(o_orderdate)')} || '.' AS said FROM orders")
def date_words(spark, sf):
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    return read_table(spark, sf, "orders").select("o_orderkey", words.verbalise_dates(F.concat(F.lit("ordered "), day, F.lit(" at 3:15 PM."))).alias("said"))


@query(f"SELECT doc_id, {number_sql('n')} AS said FROM (SELECT doc_id, doc_id * 7919 + n_chars AS n FROM documents)")
def number_words(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", words.number_words((F.col("doc_id") * 7919 + F.col("n_chars")).cast("string")).alias("said"))


# -- statistics


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def tf_raw(spark, sf):
    return index_of(spark, sf).tf.select("doc_id", "term", "tf")


@query(f"WITH {_TF} SELECT doc_id, term, round(1 + log10(tf), 6) AS ltf FROM tf")
def tf_log(spark, sf):
    return index_of(spark, sf).tf.select("doc_id", "term", F.round(1 + F.log10("tf"), 6).alias("ltf"))


@query(f"WITH {_VOCAB} SELECT term, df FROM vocab")
def doc_freq(spark, sf):
    return index_of(spark, sf).vocab.select("term", "df")


@query(f"WITH {_VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab")
def idf(spark, sf):
    return index_of(spark, sf).vocab.select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_POST} SELECT doc_id, term, round(w, 6) AS weight FROM post")
def tfidf_weights(spark, sf):
    return index_of(spark, sf).postings.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_POST} SELECT doc_id, round(n, 6) AS norm FROM norm")
def doc_norms(spark, sf):
    return index_of(spark, sf).norms.select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {_TF} SELECT (SELECT count(*) FROM tok) AS n_docs, (SELECT count(DISTINCT doc_id) FROM tok) AS n_ids, (SELECT count(DISTINCT term) FROM tf) AS n_terms")
def index_stats(spark, sf):
    return index_of(spark, sf).stats()


@query(f"WITH {_POST} SELECT doc_id, '{{' || string_agg(term || ': ' || printf('%.3f', w), ', ' ORDER BY term) || '}}' AS vector FROM post GROUP BY doc_id")
def pretty_vector(spark, sf):
    return pretty_vectors(index_of(spark, sf).postings)


# -- ranked


@query(f"WITH {_run_sql(K)} SELECT qid, rank, doc_id, score FROM run")
def ranked_topk(spark, sf):
    return ranked.search(index_of(spark, sf), items(spark, sf), K)


@query(f"WITH {_run_sql(K)} SELECT qid, rank, doc_id, score FROM run")
def ranked_topk_raw(spark, sf):
    return ranked.search(index_of(spark, sf), items(spark, sf), K, normalize=False)


_OOV = "qtext AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'zzzzqq unheardof' WHEN 1 THEN '' ELSE text END AS text FROM benchmark)"


@query(f"WITH {_run_sql(5, _OOV)} SELECT qid, rank, doc_id, score FROM run")
def ranked_oov_fallback(spark, sf):
    q = items(spark, sf).withColumn("text", F.when(F.col("qid") % 3 == 0, "zzzzqq unheardof").when(F.col("qid") % 3 == 1, "").otherwise(F.col("text")))
    return ranked.search(index_of(spark, sf), q, 5)


@query(f"WITH {_run_sql(K)} SELECT qid, rank, CAST(round(CAST(score AS DECIMAL(18, 6)), 4)::DECIMAL(18, 4) AS VARCHAR) AS score_text, doc_id, substr(coalesce(source || ' ' || text, ''), 1, 100) AS title FROM run LEFT JOIN documents USING (doc_id)")
def ranked_with_title(spark, sf):
    titled = documents(spark, sf).select("doc_id", F.concat_ws(" ", "source", "text").alias("title"))
    return present.result_rows(ranked.search(index_of(spark, sf), items(spark, sf), K), titled)


# -- Boolean

_BP = f"{_TOK}, bp AS (SELECT DISTINCT doc_id::VARCHAR AS doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM tok)), u AS (SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM tok)"


def _t(term: str) -> str:
    return f"(SELECT doc_id FROM bp WHERE term = '{term}')"


def _boolean(name: str, text: str, sql: str, k: int | None = None) -> None:
    def run(spark, sf):
        return boolean.search(index_of(spark, sf), text, k)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {_BP} SELECT doc_id FROM ({sql}) ORDER BY doc_id" + (f" LIMIT {k}" if k else "")


_boolean("bool_term", "idiot", _t("idiot"))
_boolean("bool_and", "est AND les", f"{_t('est')} INTERSECT {_t('les')}")
_boolean("bool_or", "und or este", f"{_t('und')} UNION {_t('este')}")
_boolean("bool_not", "NOT est", f"SELECT doc_id FROM u EXCEPT {_t('est')}")
_boolean("bool_and_not", "est AND NOT les", f"{_t('est')} EXCEPT {_t('les')}")
_boolean("bool_nested", "(est OR und) AND NOT (les AND pas) OR nosuchterm", f"({_t('est')} UNION {_t('und')}) EXCEPT ({_t('les')} INTERSECT {_t('pas')})")
_boolean("bool_limit", "est OR und", f"{_t('est')} UNION {_t('und')}", 25)


@query(f"WITH {_BP} {_t('est')[1:-1]} INTERSECT (SELECT doc_id FROM u EXCEPT {_t('les')}) UNION {_t('und')}")
def bool_by_joins(spark, sf):
    return boolean.evaluate_by_joins(index_of(spark, sf), "est AND NOT les OR und")


@query(f"WITH {_BP} SELECT count(*) AS total, least(count(*), 25) AS shown FROM {_t('est')}")
def bool_hit_counts(spark, sf):
    hits = boolean.evaluate(index_of(spark, sf), "est")
    return hits.agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(25)).alias("shown"))


_BATCH_TERMS = "SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS i FROM vocab QUALIFY i < 120"


@query(f"WITH {_VOCAB}, bp AS (SELECT DISTINCT doc_id::VARCHAR AS doc_id, term FROM tf), u AS (SELECT DISTINCT doc_id FROM bp), w AS ({_BATCH_TERMS}), p AS (SELECT a.i // 3 AS qid, a.term AS a, b.term AS b, c.term AS c FROM w a JOIN w b ON b.i = a.i + 1 JOIN w c ON c.i = a.i + 2 WHERE a.i % 3 = 0) SELECT qid, doc_id FROM p JOIN bp ON bp.term = p.a WHERE (doc_id, b) IN (SELECT doc_id, term FROM bp) AND (doc_id, c) NOT IN (SELECT doc_id, term FROM bp)")
def bool_batch(spark, sf):
    """40 queries over the 120 most frequent terms, in one job: a AND b AND NOT c."""
    index = index_of(spark, sf)
    terms = [r["term"] for r in index.vocab.orderBy(F.desc("df"), "term").limit(120).collect()]
    return boolean.search_many(index, {i // 3: "{} AND {} AND NOT {}".format(*terms[i : i + 3]) for i in range(0, len(terms) - 2, 3)})


@query(f"WITH {_run_sql(K)} SELECT qid, rank, doc_id, score FROM run")
def ranked_pruned(spark, sf):
    """Over an index on storage, whose documents came in two additions."""
    store, d = Store.create(spark, scratch(spark, "index")), documents(spark, sf).select("doc_id", "text")
    store.add(d.where("doc_id % 10 <> 3"))
    return pruned.search(store.add(d)[0], items(spark, sf), K)


@query(f"WITH {_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def stored_vocabulary(spark, sf):
    """Three additions, the first two merged, opened again from storage."""
    store, d = Store.create(spark, scratch(spark, "index")), documents(spark, sf).select("doc_id", "text")
    store.add(d.where("doc_id % 5 < 2"))
    store.add(d.where("doc_id % 5 < 4"))
    store.merge()
    store.add(d)
    return Store.open(spark, store.path).index().vocab.select("term", "df", F.round("idf", 6).alias("idf"))


# -- incremental


def _grown(spark, sf):
    d = documents(spark, sf)
    first = Index(d.where("lang <> 'fr'").select("doc_id", "text"), order_col="doc_id", keep=True)
    return first.add(d.select("doc_id", "text"))


@query(f"WITH {_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def incremental_add(spark, sf):
    return _grown(spark, sf)[0].vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TOK}, old AS (SELECT doc_id FROM tok JOIN documents USING (doc_id) WHERE lang <> 'fr') SELECT count(*) - (SELECT count(*) FROM old) AS added, (SELECT count(*) FROM old) AS skipped FROM documents")
def incremental_stats(spark, sf):
    return _grown(spark, sf)[1]


# -- evaluation

_QRELS = "qr AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def relevance(spark, sf):
    return evaluation.containing(documents(spark, sf).select("doc_id", "text"), items(spark, sf))


@query(f"WITH {_QRELS} SELECT qid, doc_id FROM qr")
def qrels(spark, sf):
    return relevance(spark, sf)


_AP = f"WITH {_run_sql(50)}, {_QRELS}, cuts AS (SELECT unnest([10, 20, 50]) AS k), hits AS (SELECT run.qid, rank, sum(CASE WHEN qr.doc_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY run.qid ORDER BY rank) AS h, qr.doc_id IS NOT NULL AS rel FROM run LEFT JOIN qr ON run.qid = qr.qid AND run.doc_id = qr.doc_id), ap AS (SELECT b.item_id AS qid, k, coalesce((SELECT sum(h / rank) FROM hits WHERE hits.qid = b.item_id AND rel AND rank <= k) / nullif((SELECT count(*) FROM qr WHERE qr.qid = b.item_id), 0), 0) AS ap FROM benchmark b CROSS JOIN cuts)"


def _run50(spark, sf):
    return ranked.search(index_of(spark, sf), items(spark, sf), 50)


@query(f"{_AP} SELECT qid, k, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf):
    return evaluation.average_precision(_run50(spark, sf), relevance(spark, sf), items(spark, sf)).select("qid", "k", F.round("ap", 6).alias("ap"))


@query(f"{_AP} SELECT k, round(avg(ap), 6) AS map FROM ap GROUP BY k")
def map_cutoffs(spark, sf):
    return evaluation.mean_average_precision(_run50(spark, sf), relevance(spark, sf), items(spark, sf)).select("k", F.round("map", 6).alias("map"))


@query(f"WITH {_run_sql(K)} SELECT qid::VARCHAR AS qid, rank, concat_ws(' ', qid::VARCHAR, '0', doc_id::VARCHAR, rank::VARCHAR, printf('%.6f', score), 'tf-idf_run') AS line FROM run")
def trec_run(spark, sf):
    return evaluation.trec_lines(ranked.search(index_of(spark, sf), items(spark, sf), K), "TF-IDF")


# -- dense and latent


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_inner_product(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 50 = 0) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= {K}")
def dense_topk(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return dense.search(e, e.where("vec_id % 50 = 0"), K)


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_inner_product(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 50 = 0) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= {K}")
def dense_clustered(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return clustered.search(clustered.build(e), e.where("vec_id % 50 = 0"), K)


@query()
def lsa_topk(spark, sf):
    return lsa.search(index_of(spark, sf), items(spark, sf), K)


# -- web

_LINKS = r"""raw AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1), 1) - 1 AS pos FROM pages), links AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN 'https://example.org' || href ELSE href END AS url FROM raw WHERE href <> '')"""
_BASE = "https://example.org"


@query(f"WITH {_LINKS} SELECT page_id, pos, url FROM links")
def links_extract(spark, sf):
    return web.links(read_table(spark, sf, "pages"), _BASE)


@query(f"WITH {_LINKS} SELECT page_id, pos, url FROM links QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1")
def links_dedup(spark, sf):
    return web.first_seen(web.links(read_table(spark, sf, "pages"), _BASE))


@query(f"WITH {_LINKS}, n AS (SELECT page_id, pos, url FROM links WHERE page_id < 50 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1), stop AS (SELECT min(page_id) AS p FROM pages WHERE page_id < 50 AND page_id NOT IN (SELECT page_id FROM n)) SELECT page_id, pos, url FROM n, stop WHERE p IS NULL OR page_id < p")
def crawl_frontier(spark, sf):
    return web.crawl(read_table(spark, sf, "pages"), _BASE, max_pages=50)


def _field_sql(patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"trim(regexp_extract_all(html, {_quoted(p)}, 1)[1])" for p in patterns) + ", '')"


@query("SELECT page_id, url, " + ", ".join(f"{_field_sql(p)} AS {k}" for k, p in web.FIELDS.items()) + " FROM pages WHERE regexp_matches(html, '<body') AND regexp_matches(html, '<h1')")
def page_fields(spark, sf):
    return web.page_fields(read_table(spark, sf, "pages"))


@query(r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>.*?</li>', 0)) AS part, generate_subscripts(regexp_extract_all(html, '<li>.*?</li>', 0), 1) - 1 AS pos FROM pages), f AS (SELECT page_id, pos, array_to_string(regexp_extract_all(part, 'href="([^"]*)"', 1), ' ') AS target, array_to_string(regexp_extract_all(part, '>([^<]+)</a>', 1), ' ') AS label FROM r) SELECT page_id, pos, target, label FROM f WHERE target || label <> ''""")
def nested_extract(spark, sf):
    return web.nested(read_table(spark, sf, "pages"), "<li>.*?</li>", {"target": 'href="([^"]*)"', "label": ">([^<]+)</a>"})


_PATHS = {"title": '//h1[@class="heading"] | //article/h1 | //title', "language": "/html/@lang", "author": '//a[contains(@class, "author")]'}


@query("SELECT page_id, url, replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '&amp;', '&') AS title, regexp_extract(html, '<html lang=.([a-z]*)', 1) AS language, '' AS author FROM pages")
def fields_by_path(spark, sf):
    return web.fields_by_path(read_table(spark, sf, "pages"), _PATHS, "//article")


@query(r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>.*?</li>', 0)) AS part, generate_subscripts(regexp_extract_all(html, '<li>.*?</li>', 0), 1) - 1 AS pos FROM pages) SELECT page_id, pos, regexp_extract(part, 'href="([^"]*)"', 1) AS target, regexp_extract(part, '>([^<]+)</a>', 1) AS label FROM r""")
def nested_by_path(spark, sf):
    return web.nested_by_path(read_table(spark, sf, "pages"), "//nav//li", {"target": ".//a/@href", "label": "./a"})


@query("SELECT page_id, regexp_extract(html, '<html lang=.([a-z]*)', 1) AS language, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS in_nav FROM pages")
def html_tree(spark, sf):
    n = web.html_nodes(read_table(spark, sf, "pages")).persist()
    nav = n.where("tag = 'nav'").select("page_id", F.col("node").alias("a"), F.col("last").alias("b"))
    inner = n.where("tag = 'li'").join(nav, "page_id").where("node > a and node <= b").groupBy("page_id").agg(F.count("*").alias("in_nav"))
    own = n.groupBy("page_id").agg(F.max(F.when(F.col("tag") == "html", F.col("attributes")["lang"])).alias("language"), F.count_if(F.col("tag") == "p").alias("paragraphs"))
    return own.join(inner, "page_id", "left").select("page_id", "language", "paragraphs", F.coalesce("in_nav", F.lit(0)).cast("long").alias("in_nav"))


@query(f"WITH {_LINKS}, n AS (SELECT url, page_id, pos FROM links QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1), stored AS (SELECT DISTINCT n.url, html FROM n JOIN pages p ON p.page_id = length(n.url)) SELECT url, replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '&amp;', '&') AS title, regexp_extract(html, '<html lang=.([a-z]*)', 1) AS language FROM stored")
def crawl_extract_append(spark, sf):
    """Links of all pages, each once; what is stored under an address (here the page numbered by its length) is extracted
    and appended to a file of records."""
    pages, path = read_table(spark, sf, "pages"), scratch(spark, "articles")
    frontier = web.first_seen(web.links(pages, _BASE))
    stored = frontier.select("url").distinct().join(pages.select("page_id", "html"), F.length("url") == F.col("page_id")).select("url", "html")
    for part in range(2):  # the second run finds some addresses visited
        seen = readers.read_jsonl(spark, path).select("url") if part else None
        mine = frontier if part else frontier.where("page_id % 2 = 0")
        sinks.append_jsonl(web.crawl_articles(mine, stored, {"title": _PATHS["title"], "author": "/html/@lang"}, seen), path)
    return readers.read_jsonl(spark, path).select("url", "title", F.col("author").alias("language"))


_ADDRESS = "'https://' || CASE page_id % 4 WHEN 0 THEN 'm' ELSE 'www' END || '.example.org/' || CASE page_id % 3 WHEN 0 THEN 'blog' ELSE 'news' END || '/' || CASE page_id % 5 WHEN 0 THEN 'Upper' ELSE 'a-slug' END || '-' || page_id"


@query(rf"SELECT page_id, regexp_matches({_ADDRESS}, '^https://www\.example\.org/news/[a-z0-9-]+-[0-9]+$') AS article FROM pages")
def url_predicate(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", web.article_url(F.expr(_ADDRESS), "www.example.org").alias("article"))


# -- presentation


@query("SELECT doc_id, 'ID: ' || doc_id || chr(10) || CASE WHEN coalesce(lang, '') <> '' THEN 'Title: ' || lang || chr(10) ELSE '' END || repeat('-', 60) || chr(10) || CASE WHEN length(coalesce(text, '')) > 5000 THEN substr(text, 1, 5000) || chr(10) || '[...]' ELSE coalesce(text, '') END AS preview FROM documents")
def preview(spark, sf):
    return present.preview(documents(spark, sf).select("doc_id", F.col("lang").alias("title"), "text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)\\Qth\\E')) + len(regexp_extract_all(text, '(?i)\\Qé\\E')) AS n FROM documents")
def highlight_counts(spark, sf):
    return documents(spark, sf).select("doc_id", present.highlight_count(F.col("text"), ["th", "É"]).cast("long").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)((?:the|ou|th|é)+)', '[\\1]', 'g')) AS digest, len(regexp_extract_all(text, '(?i)(?:the|ou|th|é)+')) AS marks FROM documents")
def highlight_text(spark, sf):
    marked = present.highlight(F.col("text"), ["th", "É", "the", "OU", ""], "[", "]")
    d = documents(spark, sf).select("doc_id", "text", marked.alias("marked"))
    return d.select("doc_id", F.md5(F.col("marked").cast("binary")).alias("digest"), ((F.length("marked") - F.length("text")) / 2).cast("long").alias("marks"))


# -- files: each query writes its files in a folder of its own and reads them back


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("SELECT line, CASE WHEN doc_id % 5 = 0 THEN 'wh_' || line ELSE doc_id::VARCHAR END AS id, title, digest FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line, lang AS title, md5(text) AS digest FROM documents)")
def jsonl_scan(spark, sf):
    path = scratch(spark, "articles") + ".jsonl"
    d = documents(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    line = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.col("lang").alias("title"), F.col("text").alias("content")))).otherwise(F.to_json(F.struct("id", F.col("lang").alias("title"), F.col("text").alias("content"))))
    d.orderBy("doc_id").select(line.alias("value")).write.text(path)  # files in the order of their names are the lines in order
    return readers.read_documents(spark, path).select("line", "id", "title", F.md5(F.col("content").cast("binary")).alias("digest"))


def _as_array(records: DataFrame, path: str) -> str:
    """One file with a JSON array; for small tables."""
    records.select(F.to_json(F.struct("*")).alias("x")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ","), F.lit("]"))).write.text(path)
    return path


@query("SELECT item_id::VARCHAR AS id, md5(text) AS digest FROM benchmark")
def json_array_scan(spark, sf):
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return readers.read_documents(spark, _as_array(b, scratch(spark, "documents"))).select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


_RECORDS = "item_id::VARCHAR AS qid, CASE WHEN item_id % 2 = 1 OR text = '' THEN 'q' || item_id ELSE text END AS text"


def _query_records(spark, sf):
    evidence = F.expr("transform(array(item_id * 2, null, item_id * 2, item_id + 1), x -> named_struct('id', cast(x as string)))")
    return read_table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 2 == 1, "").otherwise(F.col("text")).alias("description"), F.concat(F.lit("q"), "item_id").alias("query"), evidence.alias("evidence_list"))


@query(f"SELECT qid, md5(text) AS digest FROM (SELECT {_RECORDS} FROM benchmark)")
def query_scan(spark, sf):
    q = readers.read_queries(spark, _as_array(_query_records(spark, sf), scratch(spark, "queries")))
    return q.select("qid", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT item_id::VARCHAR AS qid, (item_id * 2)::VARCHAR AS doc_id FROM benchmark UNION SELECT item_id::VARCHAR, (item_id + 1)::VARCHAR FROM benchmark")
def qrel_scan(spark, sf):
    return readers.qrels_of(readers.read_queries(spark, _as_array(_query_records(spark, sf), scratch(spark, "qrels"))))


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_inner_product(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 50 = 0), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= {K}) SELECT concat_ws(' ', qid::VARCHAR, '0', doc_id::VARCHAR, rank::VARCHAR, printf('%.6f', score), 'tf-idf_run') AS line FROM r")
def trec_file(spark, sf):
    e, path = read_table(spark, sf, "embeddings"), scratch(spark, "run")
    sinks.write_trec(evaluation.trec_lines(dense.search(e, e.where("vec_id % 50 = 0"), K), "TF-IDF"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH c AS (SELECT f AS field, term, count(*) AS n FROM (SELECT 'source' AS f, unnest({tokens_sql('source')}) AS term FROM documents UNION ALL SELECT 'lang', unnest({tokens_sql('lang')}) FROM documents) GROUP BY ALL) SELECT 'basic' AS method, term || ' : ' || n AS line FROM c UNION ALL SELECT 'basic', '' FROM (SELECT DISTINCT field FROM c), range(2)")
def token_report_file(spark, sf):
    path = scratch(spark, "tokens")
    sinks.write_token_report(report.token_frequencies(documents(spark, sf), ("source", "lang"), {"basic": tx.TextConfig()}), path)
    return spark.read.text(path).select("method", F.col("value").alias("line"))


@query("SELECT doc_id::VARCHAR AS id, lang AS title FROM documents")
def append_file(spark, sf):
    path = scratch(spark, "crawled")
    d = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"))
    for k in range(2):
        sinks.append_jsonl(d.where(F.col("id").cast("long") % 2 == k), path)
    return readers.read_jsonl(spark, path).select("id", "title")


# -- options, catalogue, cleaned queries


@query(f"SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(regexp_replace(replace(replace(coalesce(text, ''), '\\n', ' '), chr(10), ' '), '{tx.TAG}', '', 'g')), {_quoted(tx.TOKEN)}), lambda t: regexp_replace(t, {_quoted(tx.EDGES)}, '', 'g')), lambda t: length(t) >= 4) AS tokens FROM documents")
def tokenize_options(spark, sf):
    return documents(spark, sf).select("doc_id", tx.tokens(F.col("text"), tx.TextConfig(fold=False, stop_words=(), least=4)).alias("tokens"))


@query(f"WITH {_TF} SELECT 'base' AS name, (SELECT count(*) FROM tok) AS n_docs, (SELECT count(DISTINCT term) FROM tf) AS n_terms")
def index_catalogue(spark, sf):
    d, catalogue = documents(spark, sf).select("doc_id", "text"), IndexCatalog()
    catalogue.register("base", Index(d.where("doc_id % 3 = 0"), order_col="doc_id"))
    catalogue.add("base", d)
    (name,) = catalogue.names()
    return catalogue.get(name).stats().select(F.lit(name).alias("name"), "n_docs", "n_terms")


@query(f"WITH {_BP} SELECT doc_id FROM ({_t('est')} EXCEPT {_t('les')} UNION {_t('und')})")
def bool_cleaned(spark, sf):
    index = index_of(spark, sf)
    return boolean.search(index, boolean.cleaned(index, "EST AND NOT (Les) OR UND"))


@query("SELECT (item_id % 7)::VARCHAR AS qid, max(item_id) AS pos FROM benchmark GROUP BY item_id % 7")
def repeated_qid(spark, sf):
    q = read_table(spark, sf, "benchmark").select((F.col("item_id") % 7).cast("string").alias("qid"), F.col("item_id").alias("pos"))
    return evaluation.last_of_query(q).select("qid", "pos")

"""Inverted-index statistics as relations, and a catalogue of named indexes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.text import TextConfig, joined_text, tokens, vocabulary_map


def tokenise(docs: DataFrame, config: TextConfig = TextConfig(), id_col: str = "doc_id", text_col: str | tuple[str, ...] = "text", order_col: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_ord, tokens) of the documents that have tokens; the others are in no statistics.

    Several text columns are joined by blanks. lexicon: the base forms of lemmas, if not those of the options. The
    tokens come out of a generator of one row: a filter on their number can't be moved below it, where the whole text
    would be tokenised twice.
    """
    text = F.col(text_col) if isinstance(text_col, str) else joined_text(*map(F.col, text_col))
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    out = docs.select(F.col(id_col).alias("doc_id"), order.alias("doc_ord"), F.explode(F.array(tokens(text, config))).alias("tokens"))
    return vocabulary_map(out, config, config.lexicon if lexicon is None else lexicon).where(F.size("tokens") > 0)


def log_tf(c: Column) -> Column:
    return 1 + F.log10(c)


def counted(tokenised: DataFrame) -> DataFrame:
    """(doc_id, doc_ord, terms, counts): the distinct tokens of each row, sorted and joined by newlines (no token holds one),
    and how often each occurs. Counted inside the row, by the ends of the runs of its sorted tokens, so nothing is shuffled."""
    keys = ("doc_id", "doc_ord")
    runs = tokenised.select(*keys, F.explode(F.array(F.sort_array("tokens"))).alias("s"))
    runs = runs.select(*keys, "s", F.explode(F.array(F.expr("filter(sequence(1, size(s)), i -> i = size(s) or s[i] <> s[i - 1])"))).alias("e"))
    return runs.select(*keys, F.expr("array_join(transform(e, x -> s[x - 1]), '\n')").alias("terms"), F.expr("transform(e, (x, j) -> x - if(j = 0, 0, e[j - 1]))").alias("counts"))


def repeated(bags: DataFrame) -> DataFrame:
    """(doc_id, doc_ord) of several rows."""
    return bags.groupBy("doc_id", "doc_ord").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "doc_ord")


def counts_of_rows(bags: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_ord, term, tf) of what `counted` gives; rows of which id and order repeat are one document."""
    each = bags.select("doc_id", "doc_ord", F.explode(F.arrays_zip(F.split("terms", "\n").alias("term"), F.col("counts").alias("tf"))).alias("x")).select("doc_id", "doc_ord", "x.term", F.col("x.tf").cast("long").alias("tf"))
    if repeats is None:
        return each
    marked = repeats.select(F.col("doc_id").alias("__id"), F.col("doc_ord").alias("__ord"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("doc_ord").eqNullSafe(F.col("__ord"))
    several = each.join(marked, same, "left_semi").groupBy("doc_id", "doc_ord", "term").agg(F.sum("tf").alias("tf"))
    return each.join(marked, same, "left_anti").unionByName(several)


def term_counts(tokenised: DataFrame) -> DataFrame:
    """(doc_id, doc_ord, term, tf): each row of tokenised is a document of its own, unless both id and order repeat."""
    bags = counted(tokenised)
    repeats = repeated(bags.select("doc_id", "doc_ord"))
    return counts_of_rows(bags, None if repeats.isEmpty() else repeats)


#: Terms that are broadcast to the counts, the most frequent ones; counts of the others are joined by shuffle.
HOT_TERMS = 500_000


def hot_level(vocab: DataFrame) -> int | None:
    """The least number l so that at most HOT_TERMS terms are in 2 ** l documents or more; None if even the most frequent are more."""
    level = F.floor(F.log2("df")).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in vocab.groupBy(level.alias("level")).count().collect()), reverse=True)  # 64 rows at most
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > HOT_TERMS:
            break
        least = at
    return 0 if least is not None and total <= HOT_TERMS else least


def weights(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, doc_ord, term, weight), without zero weights; terms of all documents stay in the vocabulary only.

    Few terms make up most of the counts. They are broadcast, so that only counts of rare terms are shuffled.
    """
    least = hot_level(vocab)
    weight = (log_tf(F.col("tf")) * F.col("idf")).alias("weight")
    out = []
    if least is not None:
        hot = F.broadcast(vocab.where(F.col("df") >= 2**least).select("term", "idf"))  # HOT_TERMS at most
    if least == 1:  # all others are in one document each, so their IDF is the same and nothing is shuffled
        one = vocab.where("df = 1").select("idf").first()[0]
        known = tf.join(hot, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(one)))
        return known.select("doc_id", "doc_ord", "term", weight).where("weight <> 0")
    if least is not None:
        out.append(tf.join(hot, "term").select("doc_id", "doc_ord", "term", weight))
    if least != 0:
        rare = tf if least is None else tf.join(hot.select("term"), "term", "left_anti")
        cold = vocab if least is None else vocab.where(F.col("df") < 2**least)
        out.append(rare.join(cold.select("term", "idf"), "term").select("doc_id", "doc_ord", "term", weight))
    return (out[0] if len(out) == 1 else out[0].unionByName(out[1])).where("weight <> 0")


def norms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id", "doc_ord").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def unit_weights(postings: DataFrame) -> DataFrame:
    """Weights divided by their document's norm; zero vectors are gone."""
    return postings.join(norms(postings), ["doc_id", "doc_ord"]).where("norm > 0").select("doc_id", "doc_ord", "term", (F.col("weight") / F.col("norm")).alias("weight"))


def pretty_vectors(postings: DataFrame) -> DataFrame:
    """(doc_id, vector): {term: 0.123, ...} by term."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("term", "weight"))), lambda x: F.format_string("%s: %.3f", x["term"], x["weight"]))
    dealt = postings.repartition("doc_id", "doc_ord")  # lists don't get smaller before the shuffle
    return dealt.groupBy("doc_id", "doc_ord").agg(F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}")).alias("vector")).drop("doc_ord")


def frequencies(terms: DataFrame) -> DataFrame:
    """(term, df) of rows of distinct terms (held), and how many rows there are as df of the term null; in one pass."""
    return terms.select(F.explode(F.concat(F.expr("array(cast(null as string))"), "held")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: What `keep` keeps: the counts by document, with which most else begins and which are about as large as the texts, and how many documents have each term.
KEPT = ("bags", "df", "embeddings")


#: Ids of an index that are broadcast to what is added; beyond it they meet by shuffle.
KNOWN_IDS = 2_000_000


@dataclass(frozen=True)
class Index:
    """A snapshot: documents and what follows from them. Adding makes a new snapshot, so no cache can be stale."""

    docs: DataFrame
    config: TextConfig = TextConfig()
    id_col: str = "doc_id"
    text_col: str | tuple[str, ...] = "text"
    order_col: str | None = None
    version: int = 0
    #: Keep term counts by document, and the vocabulary (memory, then disk of the executors; lost parts are computed again) for several uses.
    keep: bool = False
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    def _once(self, name: str, make):
        if name not in self._made:
            made = make()
            self._made[name] = made.persist() if self.keep and name in KEPT else made
        return self._made[name]

    @property
    def tokenised(self) -> DataFrame:
        return self._once("tokenised", lambda: tokenise(self.docs, self.config, self.id_col, self.text_col, self.order_col))

    @property
    def lexicon(self) -> DataFrame:
        """(form): the base forms that lemmas may have; those of the options, or else the words of the documents."""
        if self.config.lexicon is not None:
            return self.config.lexicon
        plain = replace(self.config, lemma=False, stem=False, numbers=False)
        return self._once("lexicon", lambda: tokenise(self.docs, plain, self.id_col, self.text_col).select(F.explode("tokens").alias("form")).distinct())

    @property
    def bags(self) -> DataFrame:
        """(doc_id, doc_ord, terms, counts) of the documents."""
        return self._once("bags", lambda: counted(self.tokenised))

    @property
    def documents(self) -> DataFrame:
        """(doc_id, doc_ord): the documents."""
        return self.bags.select("doc_id", "doc_ord")

    def _different(self, ids_only: bool = False) -> bool:
        """Whether no two rows have the same id and order (ids_only: no two the same id, and none has none); read from these columns alone, so texts
        aren't cut into tokens for it. Rows without tokens count, too, unless it is known that they have none."""

        def make():
            if not ids_only and not self.order_col:
                return True  # rows are numbered
            if not ids_only and self._made.get("different True"):
                return True  # the ids alone are
            keys = [self.id_col] if ids_only else list({self.id_col, self.order_col})
            many = self._made.get("keys", self.docs).select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            return many.where(F.expr("n > 1") | (F.col(self.id_col).isNull() if ids_only else F.lit(False))).isEmpty()

        return self._once(f"different {ids_only}", make)

    @property
    def _df(self) -> DataFrame:
        """(term, df), and the number of rows at the term null. Tokens go straight into it unless counts are there already, so
        a use of the vocabulary alone neither sorts nor keeps them."""

        def make():
            if not self._different():
                rows = self.documents.agg(F.lit(None).cast("string").alias("term"), F.count(F.lit(1)).alias("df"))
                return self.tf.groupBy("term").agg(F.count("*").alias("df")).unionByName(rows)
            if "bags" in self._made:
                return frequencies(self.bags.select(F.split("terms", "\n").alias("held")))
            return frequencies(self.tokenised.select(F.array_distinct("tokens").alias("held")))

        return self._once("df", make)

    @property
    def n_docs(self) -> int:
        return self._once("n_docs", lambda: self._df.where("term is null").agg(F.max("df")).first()[0] or 0)

    @property
    def tf(self) -> DataFrame:
        return self._once("tf", lambda: counts_of_rows(self.bags, None if self._different() else repeated(self.documents)))

    @property
    def vocab(self) -> DataFrame:
        """(term, df, idf): idf is log10(N / df), without smoothing."""
        return self._once("vocab", lambda: self._df.where("term is not null").withColumn("idf", F.log10(F.lit(float(max(self.n_docs, 1))) / F.col("df"))))

    @property
    def postings(self) -> DataFrame:
        return self._once("postings", lambda: weights(self.tf, self.vocab))

    @property
    def norms(self) -> DataFrame:
        return self._once("norms", lambda: norms(self.postings))

    def rows_by_document(self) -> DataFrame | None:
        """(doc_id, doc_ord, terms, counts) if each document is one row; None if some are several rows."""
        return self.bags.where("doc_id is not null and doc_ord is not null") if self._different() else None

    def held(self, df: DataFrame) -> DataFrame:
        """df, a few rows that several steps of a search read; kept like what `keep` keeps."""
        return self._once(f"held {len(self._made)}", lambda: df.persist()) if self.keep else df

    @property
    def bool_postings(self) -> DataFrame:
        return self._once("bool", lambda: self.bags.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.split("terms", "\n")).alias("term")).distinct())

    @property
    def universe(self) -> DataFrame:
        return self._once("universe", lambda: self.documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct())

    def flags(self, terms: list[str]) -> DataFrame:
        """(doc_id string, t0, t1, ...): for all documents, whether they have each of some terms; in one pass over them."""
        rows, held = (self.bags, F.split("terms", "\n")) if "bags" in self._made else (self.tokenised, F.col("tokens"))
        each = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array(held)).alias("held"))
        told = each.select("doc_id", *(F.array_contains("held", F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)))
        return told.groupBy("doc_id").agg(*(F.max(f"t{i}").alias(f"t{i}") for i in range(len(terms))))

    def release(self) -> None:
        """Drop what `keep` kept, and latent models."""
        for name in list(self._made):
            made = self._made.pop(name)
            if name in KEPT or name == "fresh" or name.startswith("held"):
                made.unpersist()
            elif name.startswith("latent"):
                made.release()

    def stats(self) -> DataFrame:
        """One row: documents, terms, distinct ids."""
        if self._different(ids_only=True) and self._different():
            n_docs = F.coalesce(F.max(F.when(F.col("term").isNull(), F.col("df"))), F.lit(0).cast("long"))
            return self._df.agg(n_docs.alias("n_docs"), n_docs.alias("n_ids"), F.count("term").alias("n_terms"))
        n = self.documents.agg(F.count("*").alias("n_docs"), F.countDistinct("doc_id").alias("n_ids"))
        return n.crossJoin(self.vocab.agg(F.count("*").alias("n_terms")))  # one row each

    def add(self, new: DataFrame) -> tuple[Index, DataFrame]:
        """A snapshot with the documents of new whose ids aren't indexed yet, and how many were added and skipped.

        Repeats inside new are all added, and documents without tokens don't count as indexed. Where neither the order nor
        the forms of words depend on all documents, only what is added is tokenised. Ids and order of what is indexed are kept with the
        new snapshot, and texts stay where they are up to KNOWN_IDS of them. Without `keep`, counts are made when they are asked for.
        """
        rows = self.bags if self.keep or "bags" in self._made else self.tokenised
        known = rows.select("doc_id", "doc_ord").persist()
        have = known.select(F.col("doc_id").alias(self.id_col)).distinct()
        have = F.broadcast(have) if known.count() <= KNOWN_IDS else have
        fresh = new.join(have, self.id_col, "left_anti")
        counts = new.join(have.withColumn("__have", F.lit(True)), self.id_col, "left").agg(F.sum(F.when(F.col("__have"), 0).otherwise(1)).cast("long").alias("added"), F.sum(F.when(F.col("__have"), 1).otherwise(0)).cast("long").alias("skipped"))
        grown = replace(self, docs=self.docs.unionByName(fresh, allowMissingColumns=True), version=self.version + 1, _made={"held rows": known})
        names = {self.id_col: "doc_id"} | ({self.order_col: "doc_ord"} if self.order_col else {})
        grown._made["keys"] = known.select(*(F.col(v).alias(k) for k, v in names.items())).unionByName(fresh.select(*names))
        if self.order_col and not (self.config.lemma and self.config.lexicon is None):
            some = self.docs.limit(0).unionByName(fresh, allowMissingColumns=True)
            made = tokenise(some, self.config, self.id_col, self.text_col, self.order_col)
            if self.keep:
                grown._made["fresh"] = counted(made).persist()
                grown._made["bags"] = self.bags.unionByName(grown._made["fresh"])
            else:
                grown._made["tokenised"] = self.tokenised.unionByName(made)
        return grown, counts


class IndexCatalog:
    """Named snapshots; registering a name again replaces it."""

    def __init__(self):
        self._indexes: dict[str, Index] = {}

    def register(self, name: str, index: Index) -> Index:
        self._indexes[name] = index
        return index

    def get(self, name: str) -> Index:
        return self._indexes[name]

    def add(self, name: str, new: DataFrame) -> DataFrame:
        self._indexes[name], counts = self._indexes[name].add(new)
        return counts

    def names(self) -> list[str]:
        return sorted(self._indexes)

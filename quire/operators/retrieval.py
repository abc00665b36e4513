"""BM25 retrieval and cited, extractive answers over a chunks table.

chunks: chunk_id, document_id, file_name, pages, block_ids, text, ord. queries: query_id, question.
Postings are filtered by the queries' terms before any shuffle, so a batch of questions is one job
and scores only what it matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_term, passages, raw_tokens, stem, tokenize

# fixed values: what widens a question, by concept
EXPANSIONS = [
    (r"\b(?:party|parties|counterpart(?:y|ies))\b", "between client provider vendor customer"),
    (r"\beffective\s+date\b", "effective dated entered commence"),
    (r"\b(?:term|duration|expire)\b", "term duration commence expire period"),
    (r"\brenew", "renew renewal automatically successive"),
    (r"\b(?:termination|cancel|notice)\b", "termination terminate cancellation notice days"),
    (r"\b(?:governing\s+law|jurisdiction)\b", "governed law laws jurisdiction courts"),
    (r"\b(?:fee|fees|price|cost|payment|pay)\b", "fee price amount payment invoice payable due rate"),
    (r"\b(?:sign|signature|executed)\b", "signed signature executed"),
    (r"\b(?:stamp|seal)\b", "stamp stamped seal"),
]
GENERIC = ["agreement", "contract", "document", "provide", "require", "say", "state"]
COMPARISON = r"(?i)\b(?:compare|comparison|versus|vs\.?|both|difference|respectively)\b"
ABSTAIN = "Insufficient evidence in the indexed documents to answer this question."


def term_counts(rows: DataFrame, *keep: str, exact: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """A1: ``keep``, term and tf of the rows' ``text``. Besides a row with a null term for all other tokens of a
    text (with ``terms``, a small table of term: those not in it), 0 if it has none. Counting is
    map-side first."""
    tokens = rows.select(*keep, F.explode_outer(raw_tokens(F.col("text"), exact)).alias("_t"))
    fine = F.coalesce(is_term(F.col("_t")), F.lit(False))
    tokens = tokens.select(*keep, F.when(fine, stem(F.col("_t"))).alias("_t"))
    tokens = tokens.withColumn("term", F.col("_t")) if terms is None else tokens.join(
        F.broadcast(terms), F.col("_t") == F.col("term"), "left"
    )
    return tokens.select(
        *keep, "term", F.col("_t").isNotNull().cast("long").alias("_n")
    ).groupBy(*keep, "term").agg(F.sum("_n").alias("tf"))


class BM25Index:
    """Term counts, chunk lengths, document frequencies and the average length.

    Texts are tokenised once a batch of questions: of each chunk its length and the counts of the questions'
    terms are kept (``persist``, until ``release``), which is all that statistics and scores need. ``save``
    writes all postings, by term, for an index that is asked often; ``load`` reads them."""

    def __init__(
        self, chunks: DataFrame | None, k1: float = 1.5, b: float = 0.75, exact: bool = True, saved: str | None = None,
        max_terms: int = 10_000
    ):
        if k1 <= 0 or not 0 <= b <= 1:
            raise ValueError("k1 must be positive and b between 0 and 1")
        self.k1, self.b, self.exact, self.saved, self.max_terms = k1, b, exact, saved, max_terms
        self.chunks, self._held = chunks, []
        if chunks is not None:
            self.texts = chunks.select("chunk_id", "ord", "text")

    def save(self, path: str, buckets: int = 64) -> None:
        """Postings in ``buckets`` folders by a hash of the term, sorted by term, and a row of facts."""
        rows, facts = self._counted(None)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        rows.repartition(
            "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(16))
        ).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        facts.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/facts")
        self.release()

    @classmethod
    def load(cls, spark: SparkSession, path: str, chunks: DataFrame | None = None, **given) -> BM25Index:
        index = cls(None, saved=path, **given)
        index.spark, index.chunks = spark, chunks
        return index

    def _of_terms(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A1, A2: (chunk_id, ord, len, term, tf) of the given terms, and the one row of facts (n, avg_len)."""
        first = [r["term"] for r in terms.limit(self.max_terms + 1).collect()]
        few = len(first) <= self.max_terms  # the size is checked before terms are broadcast
        if self.saved:
            facts = self.spark.read.parquet(f"{self.saved}/facts")
            postings = self.spark.read.parquet(f"{self.saved}/postings")
            if few:  # only the terms' folders and row groups are read
                buckets = facts.select(
                    F.explode(F.transform(F.array(*map(F.lit, first)), lambda t: F.pmod(F.xxhash64(t), "buckets").cast("int")))
                ).distinct().collect() if first else []
                postings = postings.where(F.col("bucket").isin([r[0] for r in buckets])).where(F.col("term").isin(first))
            else:
                postings = postings.join(terms, "term", "left_semi")
            return postings.drop("bucket"), facts.select("n", "avg_len")
        small = terms.sparkSession.createDataFrame([(t,) for t in first], "term string") if few else None
        rows, facts = self._counted(small)
        return (rows if few else rows.join(terms, "term", "left_semi")), facts

    def _counted(self, terms: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        slim = term_counts(self.texts, "chunk_id", "ord", exact=self.exact, terms=terms).persist()
        self._held.append(slim)
        lengths = slim.groupBy("chunk_id", "ord").agg(F.sum("tf").alias("len"))  # A2
        facts = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
        rows = slim.where("term is not null").join(lengths, ["chunk_id", "ord"])
        return rows.select("chunk_id", "ord", "len", "term", "tf"), facts

    def release(self) -> None:
        for held in self._held:
            held.unpersist()
        self._held = []

    def postings(self, terms: DataFrame) -> DataFrame:
        return self._of_terms(terms)[0]

    @staticmethod
    def idf(postings: DataFrame, facts: DataFrame) -> DataFrame:
        """A4, A5."""
        df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return df.crossJoin(F.broadcast(facts)).select(
            "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len"
        )  # facts is one row

    def search(self, queries: DataFrame, top_k: int = 5, min_score: float = 0.0, question: str = "question") -> DataFrame:
        """query_id, chunk_id, score, rank. Ties keep the chunks' order; the score must
        exceed min_score."""
        asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col(question), self.exact))).alias("term"))
        found, facts = self._of_terms(asked.select("term").distinct())
        length = F.when(F.col("avg_len") > 0, F.col("len") / F.col("avg_len")).otherwise(0.0)
        part = F.col("idf") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * length))
        scored = found.join(
            self.idf(found, facts), "term"
        ).join(asked, "term").groupBy("query_id", "chunk_id", "ord").agg(F.sum(part).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord", "chunk_id")
        return scored.where(F.col("score") > min_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, top_k)).select(
            "query_id", "chunk_id", "score", "rank"
        )


def bounded(rule: str, ascii_words: bool) -> str:
    """The rule with the ends of words written out: Java's differ by version. With ascii_words a letter beyond
    ASCII ends a word, as in RE2 and for tokens; else it is part of it."""
    word = "[0-9A-Za-z_]" if ascii_words else "[\\p{L}\\p{M}\\p{N}_]"
    return rule.replace("\\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def expansion(question, ascii_words: bool = False):
    """SC17, J16: the concepts' words of a question; empty if it has none."""
    fits = lambda rule: question.rlike("(?i)" + bounded(rule, ascii_words))
    return F.concat_ws(" ", *[F.when(fits(rule), F.lit(words)) for rule, words in EXPANSIONS])


def ranked_passages(
    questions: DataFrame, hits: DataFrame, chunks: DataFrame, exact: bool = True, ascii_words: bool = False
) -> DataFrame:
    """Every supported passage of the hits with its score and place (W11: the best of equal ones)."""
    names = F.regexp_extract_all("question", F.lit(bounded("\\b[A-Z][A-Za-z0-9'-]*\\b", ascii_words)), F.lit(0))
    concepts = expansion(F.col("question"), ascii_words)
    terms = questions.select(
        "query_id", "question", tokenize(F.col("question"), exact).alias("original"), tokenize(
            F.concat_ws(" ", "question", concepts), exact
        ).alias("expanded"),
        tokenize(concepts, exact).alias("concepts"), tokenize(
            F.array_join(F.slice(names, F.lit(2), F.size(names)), " "), exact
        ).alias("names"),
    )
    terms = terms.withColumn("content", F.array_except(F.array_except("original", "names"), F.array(*map(F.lit, GENERIC))))
    rows = hits.join(chunks, "chunk_id").join(terms, "query_id")
    rows = rows.select(
        "*", F.posexplode(passages(F.col("text"))).alias("pos", "passage")
    ).withColumn("terms", F.array_distinct(tokenize(F.col("passage"), exact)))
    shared = lambda c: F.size(F.array_intersect("terms", c))
    enough = F.greatest(F.lit(1), F.ceil(F.size("content") * 0.6))
    supported = (shared("expanded") > 0) & F.when(
        F.size("concepts") > 0, shared("concepts") > 0
    ).otherwise(shared("content") >= enough)
    heading = F.when((F.size("terms") < 3) & ~F.col("passage").rlike("\\d|[$£€₹]"), 1.5).otherwise(0.0)
    value = 3.0 * shared("original") + shared("expanded") + 1.5 * shared("concepts") + 0.15 * F.col("score") + F.least(
        F.size("terms"), F.lit(24)
    ) / 100 - heading
    rows = rows.where(supported).withColumn("value", F.round(value, 9))
    best = Window.partitionBy("query_id", "chunk_id", "passage").orderBy(F.desc("value"), "rank", "pos")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def answer(
    questions: DataFrame, index: BM25Index, top_k: int = 5, min_score: float = 0.05, ascii_words: bool = False
) -> DataFrame:
    """query_id, question, answer, citations, abstained. A comparison needs two documents. With
    ascii_words, words of a question end where a letter beyond ASCII begins."""
    if min_score < 0:
        raise ValueError("min_score cannot be negative")
    asked = questions.where(F.trim("question") != "").withColumn(
        "wide", F.concat_ws(" ", "question", expansion(F.col("question"), ascii_words))
    )
    hits = index.search(asked, top_k, min_score, "wide")
    rows = ranked_passages(asked, hits, index.chunks, index.exact, ascii_words).withColumn(
        "compares", F.col("question").rlike(bounded(COMPARISON, ascii_words))
    )
    place = ["value", "rank", "pos", "passage"]
    order = [F.desc("value"), *place[1:]]
    named = F.size(F.array_intersect("original", tokenize(F.concat_ws(" ", "document_id", "file_name"), index.exact))) > 0
    rows = rows.withColumn("named", named)
    rows = rows.withColumn(
        "n_named", F.size(F.collect_set(F.when(F.col("named"), F.col("document_id"))).over(Window.partitionBy("query_id")))
    )
    rows = rows.where(~F.col("compares") | (F.col("n_named") < 2) | F.col("named"))
    rows = rows.withColumn(
        "_d", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*order))
    ).where("not compares or _d = 1")
    rows = rows.withColumn(
        "_k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    ).where("_k = 1 or (compares and _k = 2)")
    cite = F.struct(
        "_k", F.col("chunk_id").alias("source_id"), "document_id", "file_name", F.get("pages", F.lit(0)).alias("page"),
        "block_ids", F.col("passage").alias("quote")
    )
    picked = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(cite)).alias("c"), F.first("compares").alias("compares")
    ).where("not compares or size(c) = 2")
    picked = picked.select("query_id", F.transform("c", lambda x: x.dropFields("_k")).alias("citations"))
    out = questions.join(picked, "query_id", "left")
    text = F.array_join(F.transform("citations", lambda x: x["quote"]), "\n")
    return out.select(
        "query_id", "question", F.coalesce(text, F.lit(ABSTAIN)).alias("answer"), "citations",
        F.col("citations").isNull().alias("abstained")
    )


def relevant_chunks(queries: DataFrame, chunks: DataFrame, stem_of=None) -> DataFrame:
    """Chunks of a relevant document with one of the phrases; all of the document's if none has."""
    stem_of = stem_of if stem_of is not None else F.regexp_replace("file_name", "\\.[^.]*$", "")
    squeezed = lambda t: F.trim(F.regexp_replace(F.lower(t), "(?U)\\s+", " "))
    pairs = queries.select(
        "query_id", "relevant_phrases", F.explode("relevant_documents").alias("stem")
    ).join(chunks.withColumn("stem", stem_of), "stem")
    hit = F.exists("relevant_phrases", lambda p: squeezed(F.col("text")).contains(squeezed(p)))
    pairs = pairs.withColumn("hit", hit).withColumn("any_hit", F.max("hit").over(Window.partitionBy("query_id")))
    return pairs.where("hit or not any_hit").select("query_id", "chunk_id").distinct()


def union_chunks(frames: list[DataFrame]) -> DataFrame:
    """U2."""
    return reduce(DataFrame.unionByName, frames)

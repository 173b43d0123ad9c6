"""Term weights: grams, vocabulary, and weights in long and in sparse form."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.patterns import bind, java
from patchlens.functions.vectors import l2_normalise
from patchlens.rules import lexicon as L

ROW_MARK = "\x00"  # never a term; one per document, so its document frequency is n
COUNT_GRAMS = 1 << 20  # grams counted together in a task, or those of one document


def tokens(text: Column, pattern: str = L.TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(java(pattern)),
                                F.lit(0))


def pairs_of(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def word_grams(text: Column, bigrams: bool = True, pattern: str = L.TOKEN_PATTERN) -> Column:
    words = tokens(text, pattern)
    if not bigrams:
        return words
    return bind({"w": words}, lambda t: F.concat(t["w"], pairs_of(t["w"])))


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character grams inside words padded by one space on each side. A padded word
    shorter than the smallest gram is given once as it is."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), java(r"\s+"), " "), " "),
                     lambda w: w != "")

    def grams(w):
        padded = F.concat(F.lit(" "), w, F.lit(" "))

        def of_size(n):
            span = F.length(padded) - n
            several = F.transform(F.sequence(F.lit(0), F.greatest(span, F.lit(0))),
                                  lambda i: F.substring(padded, i + 1, F.lit(n)))
            once = F.array(padded)
            rest = once if n == low else F.array().cast("array<string>")
            return F.when(span >= 0, several).otherwise(rest)

        return F.concat(*[of_size(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of some documents' grams at a time, and the number of documents under ROW_MARK."""
    for batch in batches:
        grams = batch.column(0)
        grams = grams.drop_null() if grams.null_count else grams
        ends = np.asarray(grams.offsets)
        at = 0
        while at < len(grams):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + COUNT_GRAMS, "right")) - 1)
            part = grams.slice(at, to - at).flatten().dictionary_encode()
            row = np.repeat(np.arange(to - at), np.diff(ends[at:to + 1]))
            if part.null_count:
                row = row[np.asarray(part.is_valid())]
                part = part.drop_null()
            code, n = np.asarray(part.indices, np.int64), len(part.dictionary)
            tf = np.bincount(code, minlength=n)
            df = np.bincount(np.unique(row * n + code) % n, minlength=n) if n else tf
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([part.dictionary.cast(pa.string()), pa.array([ROW_MARK])]),
                 pa.array(np.append(tf, to - at), pa.int64()), pa.array(np.append(df, to - at), pa.int64())],
                ["term", "tf", "df"])
            at = to


def tfidf_fit(grams: DataFrame, column: str = "grams", max_terms: int | None = L.RETRIEVAL_TERMS,
              min_docs: int = 1) -> DataFrame:
    """Vocabulary with document frequency and smooth idf.

    Tasks count the grams of many documents together, so what is exploded, shuffled and summed is one
    (term, counts) of each such part. Without `max_terms` the vocabulary may be of any size and `idx` is null.
    """
    counted = grams.select(column).mapInArrow(_counts, "term string, tf long, df long").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    is_mark = F.col("term") == ROW_MARK
    kept = counted.where(is_mark | (F.col("df") >= min_docs))
    if max_terms is not None:
        kept = kept.orderBy(is_mark.desc(), F.col("tf").desc(), "term").limit(max_terms + 1)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    if max_terms is None:  # of any size: the number of documents comes as one row, terms have no number
        docs = grams.agg(F.count(F.lit(1)).alias("n"))
        return kept.where(~is_mark).crossJoin(F.broadcast(docs)).withColumn("idf", idf).select(
            F.lit(None).cast("int").alias("idx"), "term", "tf", "df", "n", "idf")
    # the vocabulary is small from here on: bounded by max_terms
    n = F.max(F.when(is_mark, F.col("df"))).over(Window.partitionBy())
    return (kept.withColumn("n", n).where(~is_mark)
            .withColumn("idf", idf)
            .withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)
            .select("idx", "term", "tf", "df", "n", "idf"))


def tfidf_transform(grams: DataFrame, vocabulary: DataFrame, key: str, column: str = "grams",
                    sublinear: bool = False) -> DataFrame:
    """Weights in long form (key, term, weight), unit length per key. Rows per key are bounded by
    the vocabulary."""
    terms = (grams.select(key, F.explode(column).alias("term"))
             .join(vocabulary.select("term", "idf"), "term")
             .groupBy(key, "term", "idf").agg(F.count(F.lit(1)).alias("tf")))
    tf = (1 + F.log("tf")) if sublinear else F.col("tf")
    weighted = terms.select(key, "term", (tf * F.col("idf")).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / size).alias("weight"))


@dataclass
class TermWeights:
    """Fitted vocabulary held on the driver: at most `max_terms` terms."""

    terms: list[str]
    idf: list[float]
    sublinear: bool = False

    @classmethod
    def fit(cls, grams: DataFrame, column: str = "grams", max_terms: int = L.RETRIEVAL_TERMS,
            min_docs: int = 1, sublinear: bool = False) -> "TermWeights":
        rows = tfidf_fit(grams, column, max_terms, min_docs).orderBy("idx").collect()
        return cls([r["term"] for r in rows], [r["idf"] for r in rows], sublinear)

    def sparse(self, df: DataFrame, column: str = "grams") -> DataFrame:
        """Add `idx` and `val` arrays of the non-zero weights. No shuffle: counts come from the
        row's own grams, the vocabulary travels with the tasks."""
        if not self.terms:
            return df.withColumn("idx", F.array().cast("array<int>")).withColumn(
                "val", F.array().cast("array<double>"))
        counter = CountVectorizerModel.from_vocabulary(self.terms, column, "_tf")
        idf = F.array(*[F.lit(x) for x in self.idf])
        counted = (counter.transform(df).withColumn("_tf", F.unwrap_udt("_tf")).withColumns({
            "idx": F.col("_tf.indices"), "_c": F.col("_tf.values")}))

        def weight(i, c):
            tf = F.log(c) + 1 if self.sublinear else c
            return tf * F.get(idf, i)

        raw = F.zip_with("idx", "_c", weight)
        return counted.withColumn("val", l2_normalise(raw)).drop("_tf", "_c")

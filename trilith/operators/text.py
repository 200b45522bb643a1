"""Text operators (§2.7): cleaning, tokens, n-grams, vocabulary, bag of
words, TF-IDF, word vectors and pooling, keyword scores.

Term statistics are kept in long form -- (doc, term, value) rows -- so the
work is a sequence of joins and aggregates that partition by term or by
document.  Only the fitted vocabulary (bounded by ``max_features``) is ever
broadcast; per-document regrouping is bounded by the document's length.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import KEYWORDS
from ..functions.text import (BASIC_STOP, clean_text_col, kept_tokens_col, label_slug_col,
                              raw_words_col, training_stopwords, words_col)
from ..session import small_batches, stored

BROADCAST_ROWS = 2_000_000
HOT_VALUES = 4_000_000  # vector values that are broadcast
FLUSH = 200_000  # counted terms of an Arrow batch


def clean_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clean_text_col(F.col(col)))


def tokenize_basic(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Fallback tokenizer: clean, drop the 30 basic stop-words and words of
    two characters or fewer, rejoin with single spaces."""
    toks = kept_tokens_col(F.col(col), BASIC_STOP, min_len=3, raw=True)
    return df.withColumn(out or col, F.array_join(toks, " "))


def token_stats(df: DataFrame, col: str, top: int = 30) -> DataFrame:
    """Raw word count, kept-token count and the first ``top`` kept tokens."""
    toks = kept_tokens_col(F.col(col), BASIC_STOP, min_len=3, raw=True)
    return df.select("*", F.size(raw_words_col(F.col(col))).alias("n_words"),
                     F.size(toks).alias("n_tokens"),
                     F.array_join(F.slice(toks, 1, top), " ").alias("first_tokens"))


def analyzer_tokens(df: DataFrame, col: str, stopwords: list[str] | None = None,
                    out: str = "tokens") -> DataFrame:
    """Vectoriser tokens: words of 2+ characters of the cleaned text (the
    2+ word-character token rule on text that holds only letters)."""
    return df.withColumn(out, kept_tokens_col(F.col(col), stopwords or [], min_len=2, raw=True))


# ------------------------------------------------------------ lemmas

def plural_lexicon(tokens_df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Corpus-derived lemma table: a word ending in 's' or 'x' whose stem
    (the word without that letter) is itself a corpus word maps to the stem.

    Distinct words, then one equi-join of the vocabulary with itself; the
    work grows with the vocabulary, not with the number of tokens.
    """
    vocab = tokens_df.select(F.explode(tokens).alias("token")).distinct()
    cand = (vocab.where(F.substring("token", -1, 1).isin("s", "x"))
            .withColumn("lemma", F.expr("substring(token, 1, char_length(token) - 1)")))
    return cand.join(vocab.select(F.col("token").alias("lemma")), "lemma").select("token", "lemma")


def lemmatize(df: DataFrame, id_col: str, tokens: str, lexicon: DataFrame | None,
              out: str) -> DataFrame:
    """Replace every token by its lemma (token itself when absent) keeping
    order; the lexicon is broadcast only after its row count is checked."""
    if lexicon is None:
        return df.withColumn(out, F.array_join(F.col(tokens), " "))
    ex = df.select(id_col, F.posexplode(tokens).alias("pos", "token"))
    n_lex = lexicon.count()
    lex = F.broadcast(lexicon) if n_lex <= BROADCAST_ROWS else lexicon
    mapped = ex.join(lex, "token", "left").select(id_col, "pos", F.coalesce("lemma", "token").alias("lemma"))
    joined = (mapped.groupBy(id_col)
              .agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_l"))
              .select(id_col, F.array_join(F.transform("_l", lambda s: s["lemma"]), " ").alias(out)))
    return (df.join(joined, id_col, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(""))))


def normalize_text(df: DataFrame, id_col: str, col: str, lexicon: DataFrame | str | None = "plural",
                   out: str = "text_processed") -> DataFrame:
    """clean -> words -> drop (French + domain) stop-words and words of two
    characters or fewer -> lemma via ``lexicon`` -> rejoin in order.

    ``lexicon`` is a (token, lemma) DataFrame, ``"plural"`` for the
    corpus-derived plural folding, or None for no lemma step.
    """
    toks = df.withColumn("_tok", kept_tokens_col(F.col(col), training_stopwords(), 3, raw=True))
    if isinstance(lexicon, str):
        # the token table feeds both the lexicon and the lemma join: tokenise once
        toks = stored(toks, "tokens")
        lexicon = plural_lexicon(toks, "_tok")
    return lemmatize(toks, id_col, "_tok", lexicon, out).drop("_tok")


# ------------------------------------------------------------ term tables

def _grams(tokens: list, ngram_range: tuple[int, int]):
    """Twin of ``ngrams_col`` on one document's tokens."""
    lo, hi = ngram_range
    plain = None not in tokens
    for n in range(lo, hi + 1):
        if n == 1:
            yield from tokens
        elif n == 2 and plain:
            yield from map("{} {}".format, tokens, tokens[1:])
        else:
            for i in range(len(tokens) - n + 1):
                yield " ".join(t for t in tokens[i:i + n] if t is not None)


def _counted(df: DataFrame, id_col: str, tokens: str, ngram_range: tuple[int, int], term: str, count: str) -> DataFrame:
    """(doc, term, count).  Only the tokens move: rows are dealt and sorted by
    document, and a task counts one document after the other (rows with equal
    ids are one document), so it holds the terms of a single document."""
    schema = T.StructType([df.schema[id_col], T.StructField(term, T.StringType()), T.StructField(count, T.LongType())])
    id_type = T.StructType([df.schema[id_col]])
    small_batches(df.sparkSession)
    rows = df.select(id_col, tokens).where(F.col(tokens).isNotNull()).repartition(id_col).sortWithinPartitions(id_col)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(id_type).field(0).type
        ids, counts, size = [], [], 0

        def flush():
            terms = list(chain.from_iterable(counts))
            at = np.repeat(np.arange(len(ids)), [len(c) for c in counts])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow).take(pa.array(at)), pa.array(terms, pa.string()),
                 pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int64())], names=[id_col, term, count])

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not ids or doc != ids[-1] and (doc == doc or ids[-1] == ids[-1]):  # NaN is one document
                    if size >= FLUSH:
                        yield flush()
                        ids, counts, size = [], [], 0
                    ids.append(doc)
                    counts.append(Counter())
                size -= len(counts[-1])
                counts[-1].update(_grams(words, ngram_range))
                size += len(counts[-1])
        if ids:
            yield flush()

    return rows.mapInArrow(run, schema)


def ngrams(df: DataFrame, id_col: str, tokens: str = "tokens",
           ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """(doc, ngram, n, count): every n-gram occurrence counted per document."""
    grams = _counted(df, id_col, tokens, ngram_range, "ngram", "count")
    return grams.select(id_col, "ngram", F.size(F.split("ngram", " ")).cast("int").alias("n"), "count")


def term_counts(df: DataFrame, id_col: str, tokens: str = "tokens",
                ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(doc, term, tf) long form."""
    return _counted(df, id_col, tokens, ngram_range, "term", "tf")


def vocabulary(tf: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
               max_features: int | None = 5000) -> DataFrame:
    """(term, df, cf, idx): document frequency and corpus count per term,
    kept when min_df <= df <= max_df * n_docs, limited to the
    ``max_features`` most frequent (cf desc, term asc), indexed
    alphabetically.

    The limit is a top-k (each task keeps k rows, the merge sees
    k x tasks), so it never gathers the whole term table.
    """
    stats = (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
             .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.lit(n_docs))))
    if max_features is not None:
        stats = stats.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    w = Window.orderBy("term")  # at most max_features rows
    return stats.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def bow(tf: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(doc, term, count) for vocabulary terms; the vocabulary is bounded
    by ``max_features`` and broadcast."""
    return tf.join(F.broadcast(vocab.select("term", "idx")), "term").select(
        id_col, "term", "idx", F.col("tf").alias("count"))


def fit_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """Smooth idf: ln((1 + n) / (1 + df)) + 1."""
    return vocab.select("term", "idx", (F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame, id_col: str, sublinear: bool = True) -> DataFrame:
    """(doc, term, idx, weight): (1 + ln tf) x idf, L2-normalised per doc."""
    tfw = (1 + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    w = tf.join(F.broadcast(idf), "term").select(id_col, "term", "idx", (tfw * F.col("idf")).alias("w"))
    norm = Window.partitionBy(id_col)
    return w.select(id_col, "term", "idx",
                    (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("weight"))


def to_sparse_vectors(long: DataFrame, id_col: str, value: str, size: int, out: str = "features") -> DataFrame:
    """Long (doc, idx, value) rows to one ML sparse vector per document.

    Entries are gathered per document (bounded by its distinct terms); a
    small per-row helper builds the vector object from the two arrays.
    """
    agg = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("_e"))
    return agg.select(id_col, F.expr(
        f"named_struct('type', 0, 'size', {size}, 'indices', transform(_e, e -> e.idx), "
        f"'values', transform(_e, e -> CAST(e.{value} AS DOUBLE)))").alias("_s")).select(
        id_col, _sparse_from_struct("_s").alias(out))


def _sparse_from_struct(col: str):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.functions import udf

    @udf(VectorUDT())
    def mk(s):  # small per-row helper: builds the vector object
        return SparseVector(s["size"], list(s["indices"]), list(s["values"]))
    return mk(F.col(col))


# ------------------------------------------------------------ word vectors

def hashed_word_vectors(vocab_words: DataFrame, dim: int = 16, word: str = "word") -> DataFrame:
    """Deterministic word vectors from md5 bytes (byte / 255), dim <= 16.
    A reproducible stand-in for trained vectors in oracle tests."""
    h = F.md5(F.col(word))
    return vocab_words.select(word, F.array(*[
        (F.conv(F.substring(h, 2 * d + 1, 2), 16, 10).cast("double") / 255.0) for d in range(dim)]).alias("vec"))


def mean_pool(df: DataFrame, id_col: str, tokens: str, vectors: DataFrame, dim: int,
              word: str = "word", vec: str = "vec") -> DataFrame:
    """Mean of the in-vocabulary word vectors of each document (every
    occurrence counts), zeros when none; output (doc, vec array<double>).

    The vectors of the most frequent words (``HOT_VALUES`` values) are
    broadcast, so that their occurrences are summed per document before they
    move; only occurrences of the other words travel to their vectors.  Where
    all words are broadcast nothing else is counted.  Out-of-vocabulary words
    are dropped by the inner join and do not count in the mean.
    """
    occ = df.select(id_col, F.explode(tokens).alias(word))
    vt = vectors.select(word, vec)
    hot = max(1, HOT_VALUES // max(dim, 1))
    if vt.limit(hot + 1).count() <= hot:
        parts = [occ.join(F.broadcast(vt), word)]
    else:
        top = (occ.where(F.col(word).isNotNull()).groupBy(word).count().orderBy(F.desc("count"), word).limit(hot)
               .select(word))
        top = stored(top, "hot-words")
        parts = [occ.join(F.broadcast(vt.join(F.broadcast(top), word, "left_semi")), word),
                 occ.join(F.broadcast(top), word, "left_anti").join(vt.join(F.broadcast(top), word, "left_anti"), word)]
    sums = [p.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"),
                                  *[F.sum(F.col(vec)[d]).alias(f"_s{d}") for d in range(dim)]) for p in parts]
    agg = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1]).groupBy(id_col).agg(
        F.sum("_n").alias("_n"), *[F.sum(f"_s{d}").alias(f"_s{d}") for d in range(dim)])
    return (df.select(id_col).join(agg, id_col, "left")
            .select(id_col, F.array(*[F.coalesce(F.col(f"_s{d}") / F.col("_n"), F.lit(0.0))
                                      for d in range(dim)]).alias(vec)))


def word2vec(df: DataFrame, tokens: str, dim: int = 100, window: int = 5, min_count: int = 2,
             epochs: int = 10, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Skip-gram word vectors (``skipgram``); returns (word, vec array<double>)."""
    from .skipgram import word2vec as fit
    return fit(df, tokens, dim, window, min_count, epochs, seed, partitions)


def _substr_fn(w, n: int):
    return lambda i: F.substring(w, i, n)


def char_ngrams_col(word, lo: int = 3, hi: int = 6):
    """Character n-grams (lo..hi) of '<word>'."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    parts = [F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))),
                         _substr_fn(w, n)) for n in range(lo, hi + 1)]
    grams = F.concat(*parts)
    return F.filter(F.array_distinct(grams), lambda g: F.char_length(g) >= lo)


def subword_embed(word_vecs: DataFrame, words: DataFrame, dim: int, lo: int = 3, hi: int = 6) -> DataFrame:
    """Vectors for any word (seen or not) from character n-grams: each
    n-gram's vector is the mean of the vectors of the trained words that
    contain it; a word's vector is the mean over its known n-grams (zeros
    when none).  Composed after training, not trained jointly."""
    g = word_vecs.select(F.explode(char_ngrams_col(F.col("word"), lo, hi)).alias("gram"), "vec")
    gram_vecs = g.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"),
                                      *[F.sum(F.col("vec")[d]).alias(f"_s{d}") for d in range(dim)])
    gram_vecs = gram_vecs.select("gram", F.array(*[F.col(f"_s{d}") / F.col("_n") for d in range(dim)]).alias("vec"))
    q = words.select("word", F.explode(char_ngrams_col(F.col("word"), lo, hi)).alias("gram"))
    hit = q.join(gram_vecs, "gram")
    agg = hit.groupBy("word").agg(F.count(F.lit(1)).alias("_n"),
                                  *[F.sum(F.col("vec")[d]).alias(f"_s{d}") for d in range(dim)])
    return (words.select("word").join(agg, "word", "left")
            .select("word", F.array(*[F.coalesce(F.col(f"_s{d}") / F.col("_n"), F.lit(0.0))
                                      for d in range(dim)]).alias("vec")))


# ------------------------------------------------------------ labels, keywords

def label_slug(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_slug", label_slug_col(F.col(col)))


def keyword_score(df: DataFrame, col: str, lexicon: dict[str, list[str]] | None = None,
                  digits: int = 6) -> DataFrame:
    """Keyword hits per class (a keyword counts once if it occurs as a
    substring of the lower-cased text), smoothed scores
    (hits + .5) / max(total hits, 1) normalised to sum 1, arg-max with the
    first-declared class winning ties."""
    lexicon = lexicon or KEYWORDS
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    names = list(lexicon)
    hits = [sum((low.contains(w).cast("int") for w in lexicon[k]), F.lit(0)) for k in names]
    total = F.greatest(sum(hits[1:], hits[0]), F.lit(1))
    p = [(h + 0.5) / total for h in hits]
    s = sum(p[1:], p[0])
    q = [x / s for x in p]
    pred = None
    for i, k in enumerate(names):
        cond = F.lit(True)
        for j in range(len(names)):
            if j < i:
                cond = cond & (hits[i] > hits[j])
            elif j > i:
                cond = cond & (hits[i] >= hits[j])
        pred = F.when(cond, F.lit(k)) if pred is None else pred.when(cond, F.lit(k))
    conf = None
    for i, k in enumerate(names):
        conf = F.when(pred == F.lit(k), q[i]) if conf is None else conf.when(pred == F.lit(k), q[i])
    return df.select("*", sum(hits[1:], hits[0]).alias("n_hits"), pred.alias("prediction"),
                     F.round(conf, digits).alias("confidence"))


__all__ = ["clean_text", "tokenize_basic", "token_stats", "analyzer_tokens", "plural_lexicon",
           "lemmatize", "normalize_text", "ngrams", "term_counts", "vocabulary", "bow", "fit_idf",
           "tfidf", "to_sparse_vectors", "hashed_word_vectors", "mean_pool", "word2vec",
           "subword_embed", "label_slug", "keyword_score", "words_col"]

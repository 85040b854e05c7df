"""Analyzers (T13), the token table (T14), relevance (T15) and keywords.

An analyzer turns (id, text) rows into token rows (id, pos, term, kind):
``kind = 'term'`` for the (stemmed) term, ``'phon'`` for the refined-Soundex
code injected at the same position (``replace: false``). The chain order is
the reference's: tokenizer, lowercase, [elision], stop words (tested before
folding), ASCII folding, stemmer (after folding), phonetic.

All steps are native expressions over the exploded tokens, except the
stemmer, which runs once per distinct term (vocabulary job) and is joined
back; AQE splits a hot term's partition if one term dominates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions import text as X
from hemicycle.functions.stem import stem_vocabulary
from hemicycle.plans.ranking import saved

ANALYZERS = {
    # name: (tokenizer, elision, stop list, stemmer language, phonetic)
    "general": ("standard", False, None, None, True),
    "french": ("standard", True, "french", "french", True),
    "english": ("standard", False, "english", "english", True),
    "timestamped_french": ("timestamp", True, "french", "french", True),
    "timestamped_english": ("timestamp", False, "english", "english", True),
}


def normalized_tokens(df: DataFrame, id_col: str, text_col: str, analyzer: str = "french",
                      keep: list[str] = ()) -> DataFrame:
    """Tokenizer .. ASCII folding: (doc_id, pos, term) before stemming / phonetics.

    The ``standard`` token filter of the reference chains (T12) is a no-op.
    """
    return df.select(*keep, F.col(id_col).alias("doc_id"), F.inline(token_array(text_col, analyzer)))


def token_array(text_col: str, analyzer: str) -> Column:
    """The ``array<struct<pos, term>>`` of one text's normalized tokens."""
    tokenizer, elide, stops, _, _ = ANALYZERS[analyzer]
    toks = X.standard_tokens(F.col(text_col)) if tokenizer == "standard" else X.timestamp_tokens(F.col(text_col))

    def norm(t: Column) -> Column:
        t = F.lower(t)
        return X.elision(t) if elide else t

    # normalize inside the token array (each step evaluated once per token),
    # keeping each token's original position, then explode the survivors
    arr = F.transform(toks, lambda t, i: F.struct(i.alias("pos"), norm(t).alias("term")))
    if stops:
        stop_list = X.stop_words(stops)
        arr = F.filter(arr, lambda x: ~x["term"].isin(*stop_list))
    arr = F.transform(arr, lambda x: F.struct(x["pos"].alias("pos"), X.ascii_fold(x["term"]).alias("term")))
    return F.filter(arr, lambda x: x["term"] != "")


def _run_starts(sorted_col: str, key) -> Column:
    """0-based places of a sorted array at which ``key`` of the element changes."""
    arr = F.col(sorted_col)
    places = F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (key(F.get(arr, i)) != key(F.get(arr, i - 1))))


def _run_lengths(sorted_col: str, starts_col: str, entry) -> Column:
    """``entry(start, length)`` of every run."""
    arr, starts = F.col(sorted_col), F.col(starts_col)
    return F.transform(starts, lambda s, k: entry(s, F.coalesce(F.get(starts, k + 1), F.size(arr)) - s))


def with_positions(df: DataFrame, text_col: str, analyzer: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<term, positions>> of the row's text, each term once; nothing is shuffled."""
    arr = F.transform(token_array(text_col, analyzer), lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos")))
    df = df.withColumn("_s", F.array_sort(arr)).withColumn("_at", _run_starts("_s", lambda x: x["term"]))
    places = lambda s, n: F.transform(F.slice("_s", s + 1, n), lambda x: x["pos"])
    return df.withColumn(out, _run_lengths("_s", "_at", lambda s, n: F.struct(
        F.get(F.col("_s"), s)["term"].alias("term"), places(s, n).alias("positions")))).drop("_s", "_at")


def counted_terms(df: DataFrame, id_col: str, text_col: str, analyzer: str = "french", kinds: bool = False) -> DataFrame:
    """(doc_id, term, tf) of the normalized tokens, or with ``kinds`` (doc_id, term, kind, tf) of an analyzer without
    stemmer.

    Terms are counted within the row of their text, so its tokens are not shuffled; only the counts of ids borne by
    several rows are added up by a shuffle.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    keys = ["doc_id", "term", "kind"] if kinds else ["doc_id", "term"]
    repeated = _row_counts(rows.join(again, same, "left_semi"), analyzer, kinds).groupBy(*keys).agg(F.sum("tf").alias("tf"))
    return _row_counts(rows.join(again, same, "left_anti"), analyzer, kinds).unionByName(repeated)


def _row_counts(rows: DataFrame, analyzer: str, kinds: bool) -> DataFrame:
    # inline_outer: from inline a filter is inferred, and pushed down it would sort a text's tokens again for each of them
    terms = F.transform(token_array("_text", analyzer), lambda x: x["term"])
    t = rows.select("doc_id", F.array_sort(terms).alias("_s"))
    t = t.withColumn("_at", _run_starts("_s", lambda x: x))
    t = t.select("doc_id", _run_lengths("_s", "_at", lambda s, n: F.struct(
        F.get(F.col("_s"), s).alias("term"), n.cast("long").alias("tf"))).alias("_t"))
    if not kinds:
        return t.select("doc_id", F.inline_outer("_t")).where("term is not null")
    codes = F.transform("_t", lambda x: F.struct(X.refined_soundex(x["term"]).alias("term"), x["tf"].alias("tf")))
    t = t.withColumn("_c", F.array_sort(F.filter(codes, lambda x: x["term"].isNotNull())))
    t = t.withColumn("_at", _run_starts("_c", lambda x: x["term"]))
    total = lambda s, n: F.aggregate(F.slice("_c", s + 1, n), F.lit(0).cast("long"), lambda acc, x: acc + x["tf"])
    t = t.withColumn("_p", _run_lengths("_c", "_at", lambda s, n: F.struct(
        F.get(F.col("_c"), s)["term"].alias("term"), F.lit("phon").alias("kind"), total(s, n).alias("tf"))))
    plain = F.transform("_t", lambda x: F.struct(x["term"].alias("term"), F.lit("term").alias("kind"), x["tf"].alias("tf")))
    return t.select("doc_id", F.inline_outer(F.concat(plain, F.col("_p")))).where("term is not null")


def analyze(df: DataFrame, id_col: str, text_col: str, analyzer: str = "french",
            stem: bool = True, phonetic: bool = True, keep: list[str] = ()) -> DataFrame:
    """Full analyzer: (doc_id, pos, term, kind) plus the ``keep`` columns; term and
    injected code in one pass."""
    _, _, _, lang, phon = ANALYZERS[analyzer]
    keep = list(keep)
    t = normalized_tokens(df, id_col, text_col, analyzer, keep)
    if stem and lang:
        vocab = stem_vocabulary(t, "term", lang)
        t = t.join(vocab, "term").select(*keep, "doc_id", "pos", F.col("stem").alias("term"))
    kinds = [F.struct(F.col("term").alias("term"), F.lit("term").alias("kind"))]
    if phonetic and phon:
        kinds.append(F.struct(X.refined_soundex(F.col("term")).alias("term"), F.lit("phon").alias("kind")))
    return (t.select(*keep, "doc_id", "pos", F.explode(F.array(*kinds)).alias("_t"))
             .select(*keep, "doc_id", "pos", "_t.term", "_t.kind")
             .where(F.col("term").isNotNull()))


def analyzed_terms(df: DataFrame, id_col: str, text_col: str, analyzer: str = "french") -> DataFrame:
    """The tokens of ``analyze`` counted: (doc_id, term, kind, tf). Terms are counted per document before the stemming
    join, so that it carries each term of a document once."""
    _, _, _, lang, phon = ANALYZERS[analyzer]
    if not lang:
        return counted_terms(df, id_col, text_col, analyzer, kinds=phon)
    t = counted_terms(df, id_col, text_col, analyzer)
    t = t.join(stem_vocabulary(t, "term", lang), "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    kinds = [F.struct(F.col("term").alias("term"), F.lit("term").alias("kind"))]
    if phon:
        kinds.append(F.struct(X.refined_soundex(F.col("term")).alias("term"), F.lit("phon").alias("kind")))
    return (t.select("doc_id", "tf", F.explode(F.array(*kinds)).alias("_t")).select("doc_id", "_t.term", "_t.kind", "tf")
             .where(F.col("term").isNotNull()).groupBy("doc_id", "term", "kind").agg(F.sum("tf").alias("tf")))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf) - the inverted index rows; ``counted_terms`` are such rows already."""
    if "tf" in tokens.columns:
        return tokens.select("doc_id", "term", "tf")
    return tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def keyword_topk(tokens: DataFrame, k: int = 20) -> DataFrame:
    """A9 re-aimed: top-k terms per document by TF-IDF (tf * ln(N / df)).

    Ties break on term. ``row_number <= k`` plans as a partial WindowGroupLimit
    before the shuffle, so a long document sends at most k rows per partition.
    """
    tf = saved(term_frequencies(tokens))  # read three times
    n_docs = tf.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("_N")).scalar()
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    scored = (tf.join(df_, "term")
                .withColumn("score", F.round(F.col("tf") * F.log(n_docs / F.col("_df")), 6)))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("term"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                  .select("doc_id", F.col("rank").cast("bigint").alias("rank"), "term", "tf", "score"))


def index_fields(df: DataFrame, id_col: str, fields: list[str], analyzer: str = "french") -> DataFrame:
    """One token table over several text fields: (doc_id, field, pos, term, kind)."""
    out = None
    for f in fields:
        t = analyze(df.where(F.col(f).isNotNull()), id_col, f, analyzer).withColumn("field", F.lit(f))
        out = t if out is None else out.unionByName(t)
    return out.select("doc_id", "field", "pos", "term", "kind")


def indexed_terms(df: DataFrame, id_col: str, fields: list[str], analyzer: str = "general") -> DataFrame:
    """The rows of ``index_fields`` counted: (doc_id, field, term, kind, tf), for an analyzer without stemmer."""
    out = None
    for f in fields:
        t = counted_terms(df, id_col, f, analyzer, kinds=True).withColumn("field", F.lit(f))
        out = t if out is None else out.unionByName(t)
    return out.select("doc_id", "field", "term", "kind", "tf")


def scrutiny_keywords(scrutinies: DataFrame, k: int = 20, analyzer: str = "french") -> DataFrame:
    """A9 on roll calls: keywords of ``title + summary + info + amendments`` (missing
    fields empty), at most ``k`` per roll call, best first, as the document's
    ``keywords`` array (bounded by k)."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) if c in scrutinies.columns else F.lit("")
                               for c in ("title", "summary", "info", "amendments")])
    toks = normalized_tokens(scrutinies.select("uuid", text.alias("_text")), "uuid", "_text", analyzer)
    top = keyword_topk(toks, k)
    return (top.groupBy(F.col("doc_id").alias("uuid"))
               .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_k"))
               .select("uuid", F.transform("_k", lambda x: x["term"]).alias("keywords")))

"""Name resolution (J1), ranked name search with highlight (F3, F4, X18), typeahead.

The reference resolves each voter name with one blocking search call and
searches names with a query string. Here both are set-based joins between
analyzed mention tokens and an analyzed directory (token rows of the french
analyzer: stems plus injected refined-Soundex codes):

* a mention position matches a directory entry when any of its terms (stem
  or code) is among the entry's terms; every position must match (AND);
* candidates come from the mention's *rarest* position only (smallest
  document frequency), then every position is verified with an exact
  semi-join on (uuid, term). Nothing is capped; the directory is reduced to distinct
  names first, so a mention of one common word meets each name with it once;
* score = sum over matched terms of idf^2 / sqrt(entry length) with
  idf = 1 + ln(N / (df + 1)); ties break on uuid; top-1 per mention is
  ``row_number() = 1`` (partial WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions import text as X
from hemicycle.operators.analysis import analyze, normalized_tokens
from hemicycle.functions.stem import stem_vocabulary
from hemicycle.plans.ranking import checkpointed

SEARCH_CAP = 1000      # the reference's search result size
TYPEAHEAD_ROWS = 8     # the widget's visible rows


def distinct_names(directory: DataFrame) -> DataFrame:
    """(uuid, name, n): entries of one name share tokens and scores, so only the smallest uuid can win a tie.
    ``n`` keeps the number of entries for the document frequencies."""
    return (directory.where(F.col("name").isNotNull()).groupBy("name")
            .agg(F.min("uuid").alias("uuid"), F.count_distinct("uuid").alias("n")).select("uuid", "name", "n"))


class DirectoryIndex:
    """The analyzed directory: token rows by distinct name, document frequencies over all entries. Built once
    (checkpointed), then read by any number of searches and resolutions."""

    def __init__(self, directory: DataFrame, analyzer: str = "french", toks: DataFrame | None = None):
        self.directory, self.analyzer = directory, analyzer
        self.names = checkpointed(distinct_names(directory))
        if toks is None:
            toks = analyze(self.names, "uuid", "name", analyzer).withColumnRenamed("doc_id", "uuid")
        self.toks = checkpointed(toks)
        n = directory.select("uuid").distinct().agg(F.count(F.lit(1)).alias("_N")).scalar()
        self.terms = checkpointed(self.toks.select("term", "uuid").distinct())
        self.dfs = checkpointed(self.terms.join(self.names.select("uuid", "n"), "uuid").groupBy("term").agg(F.sum("n").alias("df"))
                                .withColumn("idf", 1 + F.log(n / (F.col("df") + 1))).select("term", "df", "idf"))
        # one 'term' token per position: the entry length is a plain count
        self.lens = self.toks.where(F.col("kind") == "term").groupBy("uuid").agg(F.count(F.lit(1)).alias("len"))


def resolve_names(mentions: DataFrame, directory: DataFrame, analyzer: str = "french") -> DataFrame:
    """J1 + W5: (mention) -> (mention, uuid, score); unresolved mentions keep a null uuid.

    An empty mention, or one made only of stop words, resolves to null. A mention meets each distinct
    name at most once, however many entries bear it.
    """
    m = mentions.select(F.col("mention")).where(F.col("mention").isNotNull()).distinct()
    # one analyzer pass (one stemming vocabulary) over distinct names and mentions together
    uuid_type = directory.schema["uuid"].dataType
    names = distinct_names(directory)
    both = (names.select(F.lit("d").alias("_side"), F.col("uuid").cast("string").alias("_key"), F.col("name").alias("_text"))
            .unionByName(m.select(F.lit("m").alias("_side"), F.col("mention").alias("_key"),
                                  F.col("mention").alias("_text"))))
    all_toks = checkpointed(analyze(both, "_key", "_text", analyzer, keep=["_side"]))
    index = DirectoryIndex(directory, analyzer, all_toks.where(F.col("_side") == "d").select(
        F.col("doc_id").cast(uuid_type).alias("uuid"), "pos", "term", "kind"))
    mq_k = (all_toks.where(F.col("_side") == "m")
                    .select(F.col("doc_id").alias("mention"), "pos", "term", "kind"))
    npos = mq_k.where(F.col("kind") == "term").groupBy("mention").agg(F.count(F.lit(1)).alias("_npos"))
    mq = checkpointed(mq_k.select("mention", "pos", "term").distinct())
    # anchor: the position whose terms are rarest in the directory
    weights = (mq.join(index.dfs.select("term", "df"), "term", "left")
                 .groupBy("mention", "pos").agg(F.sum(F.coalesce("df", F.lit(0))).alias("_w")))
    anchor = weights.groupBy("mention").agg(
        F.min_by("pos", F.struct("_w", "pos")).alias("pos"))
    anchor_terms = mq.join(anchor, ["mention", "pos"], "left_semi")
    cand = anchor_terms.join(index.terms, "term").select("mention", "uuid").distinct()
    # verify every position on (uuid, term)
    checks = cand.join(mq, "mention")
    matched = checks.join(index.terms, ["uuid", "term"], "left_semi")
    per_pos = (matched.join(index.dfs.select("term", "idf"), "term").join(index.lens, "uuid")
                      .groupBy("mention", "uuid", "pos")
                      .agg(F.sum(F.col("idf") * F.col("idf") / F.sqrt(F.col("len"))).alias("_ps")))
    scored = (per_pos.groupBy("mention", "uuid")
                     .agg(F.count(F.lit(1)).alias("_hit"), F.sum("_ps").alias("_s"))
                     .join(npos, "mention")
                     .where(F.col("_hit") == F.col("_npos"))
                     .withColumn("score", F.round(F.col("_s"), 9)))
    w = Window.partitionBy("mention").orderBy(F.col("score").desc(), F.col("uuid"))
    best = (scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
                  .select("mention", "uuid", F.round("score", 6).alias("score")))
    return m.join(best, "mention", "left")


def resolve_ballots(ballots: DataFrame, directory: DataFrame, name_col: str = "voter_name") -> DataFrame:
    """J1 applied to named ballots: adds voter_uuid (null when unresolved), left join back."""
    res = resolve_names(ballots.select(F.col(name_col).alias("mention")), directory)
    # a hash table of distinct names: the ballots of a name that most of them bear stream past it, unsorted
    return (ballots.join(res.select(F.col("mention").alias(name_col), F.col("uuid").alias("voter_uuid")).hint("shuffle_hash"),
                         name_col, "left"))


# --------------------------------------------------------------------------
# prefix search + highlight
# --------------------------------------------------------------------------

def _split_query(q: str) -> tuple[str, str]:
    parts = q.split()
    if not parts:
        raise ValueError("empty search")
    return " ".join(parts[:-1]), parts[-1].lower()


def search(directory: DataFrame | DirectoryIndex, q: str, cap: int = SEARCH_CAP, analyzer: str = "french") -> DataFrame:
    """``q*`` with AND: every analyzed position of the text before the last word
    must match, and some token must start with the (lower-cased, unanalyzed)
    last word. A text before it without any analyzed position (stop words only) asks for nothing.
    Output (uuid, name, name_highlight, score, rank), best first.

    Pass a ``DirectoryIndex`` to search an index that is built once.
    """
    index = directory if isinstance(directory, DirectoryIndex) else DirectoryIndex(directory, analyzer)
    spark = index.directory.sparkSession
    head, prefix = _split_query(q)
    hq = analyze(spark.createDataFrame([(head,)], "mention string").withColumn("_id", F.lit(0)),
                 "_id", "mention", index.analyzer).select("pos", "term").distinct()
    asked = [(r.pos, r.term) for r in hq.collect()] if head else []  # the words of one query
    cand = index.toks.where(F.col("term").startswith(prefix)).select("uuid").distinct()
    score, qterms = F.lit(1.0) / F.sqrt(F.col("len")), None
    if asked:
        hq = spark.createDataFrame(asked, "pos int, term string")
        matched = (index.terms.where(F.col("term").isin(*{t for _, t in asked})).join(hq, "term")
                   .join(cand, "uuid", "left_semi"))
        hs = (matched.join(index.dfs.select("term", "idf"), "term")
                     .groupBy("uuid").agg(F.count_distinct("pos").alias("_hit"),
                                          F.sum(F.col("idf") * F.col("idf")).alias("_w"))
                     .where(F.col("_hit") == len({p for p, _ in asked})))
        cand = cand.join(hs.select("uuid", "_w"), "uuid")
        score = (F.col("_w") + F.lit(1.0)) / F.sqrt(F.col("len"))
        qterms = sorted({t for _, t in asked})
    # hits by distinct name, then every entry that bears it
    by_name = (cand.join(index.lens, "uuid").withColumn("score", F.round(score, 6))
               .join(index.names.select("uuid", "name"), "uuid").select("name", "score"))
    hits = (index.directory.select("uuid", "name").distinct().join(by_name, "name").select("uuid", "name", "score")
            .orderBy(F.col("score").desc(), F.col("uuid")).limit(cap))
    return highlight(hits, prefix, qterms, index.analyzer)


def highlight(hits: DataFrame, prefix: str, qterms: list[str] | None, analyzer: str) -> DataFrame:
    """X18 + J13: wrap each name token whose analyzed term (stem or code) matched in
    <strong>, attached to the same hit row. O4: the whole field is one fragment,
    so the highlight never reorders hits.

    The whole field is one fragment (``number_of_fragments: 0``). Tokens and
    the text between them come from the same word pattern, so the rebuilt
    string is the original name with tags inserted.
    """
    lang = {"french": "french", "english": "english"}.get(analyzer)
    nt = normalized_tokens(hits.select("uuid", "name"), "uuid", "name", analyzer)
    if lang:
        vocab = stem_vocabulary(nt, "term", lang)
        nt = nt.join(vocab, "term").select("doc_id", "pos", F.col("stem").alias("term"))
    nt = nt.withColumn("code", X.refined_soundex(F.col("term")))
    flag = F.col("term").startswith(prefix) | F.coalesce(F.col("code").startswith(prefix), F.lit(False))
    if qterms:  # a hit holds all its query terms, so a term or code among them has matched
        flag = flag | F.col("term").isin(*qterms) | F.coalesce(F.col("code").isin(*qterms), F.lit(False))
    flags = (nt.select("doc_id", "pos", flag.alias("_f"))
               .groupBy(F.col("doc_id").alias("uuid"))
               .agg(F.collect_list(F.struct("pos", "_f")).alias("_fl")))
    toks = X.standard_tokens(F.col("name"))
    seps = F.split(F.col("name"), X.WORD_PATTERN, -1)
    marked = F.transform(toks, lambda t, i: F.concat(
        F.when(F.exists("_fl", lambda s: (s["pos"] == i) & s["_f"]),
               F.concat(F.lit("<strong>"), t, F.lit("</strong>"))).otherwise(t),
        F.element_at(seps, i + 2)))
    out = hits.join(flags, "uuid", "left").withColumn("_fl", F.coalesce("_fl", F.array().cast(
        "array<struct<pos:int,_f:boolean>>")))
    w = Window.orderBy(F.col("score").desc(), F.col("uuid"))  # over at most `cap` hits
    return out.select("uuid", "name",
                      F.concat(F.element_at(seps, 1), F.array_join(marked, "")).alias("name_highlight"),
                      "score", F.row_number().over(w).cast("bigint").alias("rank"))


# --------------------------------------------------------------------------
# typeahead
# --------------------------------------------------------------------------

def typeahead(items: DataFrame, q: str, rows: int = TYPEAHEAD_ROWS, matcher=None, sorter=None,
              highlighter=None) -> DataFrame:
    """O7 three-bucket rank over (item, input_order): begins-with (case-insensitive),
    contains (case-sensitive), contains (case-insensitive); stable inside a bucket;
    the first ``rows`` items, highlighted (X19).

    G4: ``matcher(item, q) -> Column[bool]``, ``sorter(item, q) -> Column`` (bucket key)
    and ``highlighter(item, q) -> Column[str]`` replace the defaults.
    """
    lq = q.lower()
    item = F.col("item")
    match = matcher(item, q) if matcher else F.contains(F.lower(item), F.lit(lq))
    bucket = sorter(item, q) if sorter else (
        F.when(F.lower(item).startswith(lq), F.lit(0))
         .when(F.contains(item, F.lit(q)), F.lit(1)).otherwise(F.lit(2)))
    hl = highlighter(item, q) if highlighter else X.highlight_substring(item, q)
    top = items.where(match).withColumn("bucket", bucket).orderBy("bucket", "input_order").limit(rows)
    w = Window.orderBy("bucket", "input_order")  # at most `rows` rows
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "item", hl.alias("highlighted"))

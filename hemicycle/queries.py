"""Registered queries: one per operator family of SURVEY §2 / §7.5.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables. Parameters that are part of a feature (a search string,
a tree edit, a result cap of the reference) are module constants here.
"""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.functions import text as X
from hemicycle.operators import analysis as A
from hemicycle.operators import ballots as B
from hemicycle.operators import edit_log as EL
from hemicycle.operators import extract as E
from hemicycle.operators import frontier as FR
from hemicycle.operators import resolve as R
from hemicycle.operators.text_index import TextIndex
from hemicycle.operators import tree as H
from hemicycle.plans import paging as P
from hemicycle.session import scratch_path
from hemicycle.sources import rollcall_pages as RP
from hemicycle.sources import tables as T
from hemicycle.sources import tree_files as TF
from hemicycle.streaming import upsert as U
from hemicycle.streaming.pages import stream_extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- roll calls

@register("rollcall_tallies")
def rollcall_tallies(spark, sf_dir):
    return B.tallies(T.ballots(spark, sf_dir))


@register("rollcall_latest")
def rollcall_latest(spark, sf_dir, k: int = B.HISTORY_CAP):
    """Flagship: latest roll calls with tallies and outcome (top-k report, the reference's result size)."""
    t = B.tallies(T.ballots(spark, sf_dir))
    s = T.scrutinies(spark, sf_dir)
    return (t.join(s, "scrutiny_uuid")
             .orderBy(F.col("date").desc_nulls_last(), F.col("scrutiny_uuid")).limit(k)
             .select("scrutiny_uuid", B.display_date(F.col("date")).alias("date_display"),
                     "yea", "nay", "abs", "outcome"))


@register("rollcall_group_stance")
def rollcall_group_stance(spark, sf_dir):
    bg = B.with_group(T.ballots(spark, sf_dir), T.deputies(spark, sf_dir))
    return B.group_tallies(bg).withColumn("group_label", B.capitalize(F.col("group_name")))


@register("voter_history_topk")
def voter_history_topk(spark, sf_dir):
    return B.voter_history(T.ballots(spark, sf_dir), T.scrutinies(spark, sf_dir), B.HISTORY_CAP)


@register("voter_totals")
def voter_totals(spark, sf_dir):
    return B.voter_totals(T.ballots(spark, sf_dir)).withColumn("vote_label", B.vote_label(F.col("vote")))


@register("votes_nested_roundtrip")
def votes_nested_roundtrip(spark, sf_dir):
    bg = B.with_group(T.ballots(spark, sf_dir), T.deputies(spark, sf_dir))
    flat = B.flatten_votes(B.nest_votes(bg))
    return (flat.groupBy("scrutiny_uuid", "group_name", "vote")
                .agg(F.count(F.lit(1)).alias("n_ballots"),
                     F.count("voter_uuid").alias("n_resolved")))


@register("nested_tallies")
def nested_tallies(spark, sf_dir):
    bg = B.with_group(T.ballots(spark, sf_dir), T.deputies(spark, sf_dir))
    t = B.nested_tallies(B.nest_votes(bg))
    return t.withColumn("outcome", B.outcome(F.col("yea"), F.col("nay")))


@register("term_filter_nested")
def term_filter_nested(spark, sf_dir):
    d = T.deputies(spark, sf_dir)
    nested = B.nest_votes(B.with_group(T.ballots(spark, sf_dir), d))
    return B.voted_pairs(nested, d)


@register("voter_history_top5")
def voter_history_top5(spark, sf_dir):
    """W6 + O1 with a cap that binds."""
    return B.voter_history(T.ballots(spark, sf_dir), T.scrutinies(spark, sf_dir), 5)


DEPUTY_UUID = 7


@register("deputy_page")
def deputy_page(spark, sf_dir):
    """S6 + J3 + J4 + P19: one deputy's profile with the history of each vote type."""
    profile, history = B.deputy_page(T.deputies(spark, sf_dir), T.ballots(spark, sf_dir), T.scrutinies(spark, sf_dir), DEPUTY_UUID)
    return history.join(profile.withColumnRenamed("uuid", "voter_uuid"), "voter_uuid")


@register("term_filter_one")
def term_filter_one(spark, sf_dir):
    """F1 on the nested form: roll calls in whose ``nay`` lists one deputy occurs."""
    nested = B.nest_votes(B.with_group(T.ballots(spark, sf_dir), T.deputies(spark, sf_dir)), DOCUMENT_CHUNK)
    return B.filter_voted(nested, DEPUTY_UUID, "nay").select("scrutiny_uuid").distinct()


DOCUMENT_CHUNK = 4  # short lists, so that documents have several parts here


@register("scrutiny_documents")
def scrutiny_documents(spark, sf_dir):
    """K2 + P15 + A4 + K1/U4: documents of the ``yea`` ballots, then complete ones replacing those of even keys;
    read back as ordered lists."""
    bg = B.with_group(T.ballots(spark, sf_dir), T.deputies(spark, sf_dir))
    s = T.scrutinies(spark, sf_dir).withColumnRenamed("scrutiny_uuid", "uuid")
    parts = T.parts(spark, sf_dir, "lineitem")
    old = B.scrutiny_documents(s, bg.where("vote = 'yea'"), strict=True, chunk=DOCUMENT_CHUNK, parts=parts)
    new = B.scrutiny_documents(s.where("uuid % 2 = 0"), bg.where("scrutiny_uuid % 2 = 0"), strict=True, chunk=DOCUMENT_CHUNK, parts=parts)
    docs = B.replace_documents(old, new).select(F.col("uuid").alias("scrutiny_uuid"), "date", "part", "votes")
    flat = B.flatten_votes(docs, DOCUMENT_CHUNK)
    dates = docs.select("scrutiny_uuid", B.display_date(F.col("date")).alias("date_display"))
    return flat.repartition(parts, "scrutiny_uuid").join(dates.repartition(parts, "scrutiny_uuid").distinct(), "scrutiny_uuid")


@register("rollcall_pages_roundtrip")
def rollcall_pages_roundtrip(spark, sf_dir):
    """The roll calls written as legislature pages (both layouts, repeated
    index and vote pages), extracted again."""
    s, b, _ = E.scrutinies_from_pages(RP.rollcall_pages(spark, sf_dir))
    return _ballot_rows(s, b)


def _ballot_rows(s, b):
    return (b.join(s.select(F.col("uuid").alias("scrutiny_uuid"), "title", B.display_date(F.col("date")).alias("date_display"), "info"),
                   "scrutiny_uuid")
            .select("scrutiny_uuid", "title", "date_display", "info", "group_key", "vote", F.col("ord").cast("long").alias("ord"), "voter_name"))


@register("rollcall_scrutinies")
def rollcall_scrutinies(spark, sf_dir):
    """One row per roll call written as pages and extracted again, with the law its info
    page names. ``strict_file_href`` is the file link as the reference's overwriting leaves it."""
    f = E.latest_pages(E.facts(RP.rollcall_pages(spark, sf_dir)))
    read = E.linked(f, E.index_rows(f))
    s, _, _ = E.scrutinies_from_facts(f, E.index_rows(f), read=read)
    strict = E.scrutinies_from_facts(f, E.index_rows(f), strict=True, read=read)[0].select("uuid", F.col("file_href").alias("strict_file_href"))
    return s.join(strict, "uuid").select("uuid", "leg", "num", "title", B.display_date(F.col("date")).alias("date_display"), "url", "info",
                                         "summary", "law_title", "law_href", "file_href", "strict_file_href")


STREAM_FILES = 6  # files the pages land in, one per micro-batch


@register("rollcall_pages_streamed")
def rollcall_pages_streamed(spark, sf_dir):
    """R1 + R2: the pages of ``rollcall_pages_roundtrip`` landing as files in no order, extracted batch by batch through
    keyed state; the same rows as the batch extraction."""
    base = scratch_path(spark, f"stream/{_uuid.uuid4().hex}")
    pages = RP.rollcall_pages(spark, sf_dir)
    pages.repartition(STREAM_FILES, F.xxhash64("page_id")).write.parquet(f"{base}/land")
    arriving = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/land")
    tables = stream_extract(spark, arriving, f"{base}/out", f"{base}/checkpoint", files_per_batch=2 * STREAM_FILES)
    s = tables.scrutinies()
    return _ballot_rows(s, tables.ballots(s))


@register("rollcall_rejects")
def rollcall_rejects(spark, sf_dir):
    """D3 + O10: pages and rows the extraction drops, with the reason, on pages some of which are broken."""
    return E.rejected(RP.rollcall_pages(spark, sf_dir, broken=True))


EARLY = "1997-06-01"  # legislatures whose first roll call is before this day


@register("rollcall_legislatures")
def rollcall_legislatures(spark, sf_dir):
    """Roll calls stored in folders by legislature (here the year); the tallies of the legislatures that a filter on
    their table leaves read only the folders of those (dynamic partition pruning)."""
    base = scratch_path(spark, f"rollcalls/{_uuid.uuid4().hex}")
    s = T.scrutinies(spark, sf_dir).withColumn("leg", F.year("date").cast("string"))
    s = s.select(X.composite_key(F.col("leg"), F.col("scrutiny_uuid").cast("string")).alias("uuid"), "scrutiny_uuid", "leg", "date")
    b = T.ballots(spark, sf_dir).join(s.select("scrutiny_uuid", "uuid"), "scrutiny_uuid").select(F.col("uuid").alias("scrutiny_uuid"), "vote")
    E.save_rollcalls(s.drop("scrutiny_uuid"), b, base)
    stored = spark.read.schema("uuid string, date timestamp_ntz, leg string").parquet(f"{base}/scrutinies")
    stored.groupBy("leg").agg(F.min("date").alias("first_day"), F.count(F.lit(1)).alias("n_scrutinies")).write.parquet(f"{base}/legislatures")
    legs = spark.read.schema("leg string, first_day timestamp_ntz, n_scrutinies long").parquet(f"{base}/legislatures")
    ballots = spark.read.schema("scrutiny_uuid string, vote string, leg string").parquet(f"{base}/ballots")
    early = legs.where(F.col("first_day") < F.lit(EARLY).cast("timestamp_ntz"))
    return (ballots.join(early, "leg").groupBy("leg", "n_scrutinies", "vote").agg(F.count(F.lit(1)).alias("n_ballots")))


@register("rollcall_resolved")
def rollcall_resolved(spark, sf_dir):
    """J1 on named ballots (``resolve_ballots``): names become uuids, unresolved voters stay null and count."""
    li, p = T.table(spark, sf_dir, "lineitem"), T.table(spark, sf_dir, "part")
    name = F.when(F.col("l_linenumber") % 5 == 0, F.lit("Nobody Zzyzx")).otherwise(F.col("p_name"))
    parts = T.parts(spark, sf_dir, "lineitem")
    votes = li.where(F.col("l_returnflag").isin(*T.VOTE_OF_FLAG)).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    named = (votes.repartition(parts, "l_partkey").join(p.repartition(parts, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("scrutiny_uuid"), T.vote_of_flag(F.col("l_returnflag")).alias("vote"), name.alias("voter_name")))
    # few names hold most ballots: the distinct roll calls of a name are counted in many tasks
    return (R.resolve_ballots(named, T.name_directory(spark, sf_dir)).repartition(parts, "voter_uuid", "vote", "scrutiny_uuid")
            .groupBy("voter_uuid", "vote")
            .agg(F.count(F.lit(1)).alias("n_ballots"), F.count_distinct("scrutiny_uuid").alias("n_scrutinies")))


@register("random_pick")
def random_pick(spark, sf_dir):
    return B.random_pick(T.deputies(spark, sf_dir), seed=20)


# ---------------------------------------------------------------- hierarchy


TREE_SEARCH = "customer#00000012"          # F9 needle (case / accent-insensitive)
TREE_REMOVE_ID = 2                          # region 0 and its subtree
TREE_MOVE = (10, 5, 1)                      # nation 0 -> region 3, position 1
TREE_COPY = (11, 2, 0)                      # nation 1 copied under region 0, position 0
TREE_EDITS = [
    {"op": "create", "ref_id": 3, "position": 0, "title": "new node", "type": "nation"},
    {"op": "rename", "id": 10, "title": "Renamed"},
    {"op": "move", "id": 12, "ref_id": 2, "position": 99},
    {"op": "copy", "id": 13, "ref_id": 4, "position": 1},
    {"op": "remove", "id": 14},
    {"op": "remove", "id": 1},               # refused: the root
]
# Type rules of the demo hierarchy (H15): max_children, max_depth (-1 unlimited), valid_children.
TREE_RULES = [
    ("root", 5, -1, ["region"]),
    ("region", 4, 1, ["nation"]),
    ("nation", -1, -1, ["customer"]),
    ("customer", 0, 0, ["none"]),
]


def _numbered(spark, sf_dir):
    return H.number_tree(H.tree_from_tables(spark, sf_dir))


@register("tree_numbering")
def tree_numbering(spark, sf_dir):
    return _numbered(spark, sf_dir)


@register("tree_descendants")
def tree_descendants(spark, sf_dir):
    """H3 for every node, from the parent pointers."""
    return H.ancestor_pairs(H.tree_from_tables(spark, sf_dir))


@register("tree_descendants_nested_set")
def tree_descendants_nested_set(spark, sf_dir):
    """J5 on the nested set alone (lft/rgt): the equi-join on dyadic blocks."""
    return H.descendants(_numbered(spark, sf_dir))


@register("tree_path")
def tree_path(spark, sf_dir):
    return H.paths(_numbered(spark, sf_dir))


@register("tree_search")
def tree_search(spark, sf_dir):
    return H.search_ancestors(_numbered(spark, sf_dir), TREE_SEARCH)


@register("tree_analyze")
def tree_analyze(spark, sf_dir):
    return H.analyze(_numbered(spark, sf_dir))


@register("tree_remove")
def tree_remove(spark, sf_dir):
    return H.remove_subtree(_numbered(spark, sf_dir), TREE_REMOVE_ID)


TREE_REMOVE_IDS = [3, 12, 17, 17, None, 999_999_999]  # region 1, two nations (one listed twice), a null and an unknown id


@register("tree_remove_many")
def tree_remove_many(spark, sf_dir):
    """F13 + U3 + H6 for a frame of ids: several subtrees excluded at once, null-safe, intervals shifted by running sums."""
    return H.remove_subtrees(_numbered(spark, sf_dir), spark.createDataFrame([(i,) for i in TREE_REMOVE_IDS], "id long"))


@register("tree_move")
def tree_move(spark, sf_dir):
    return H.move_subtree(_numbered(spark, sf_dir), *TREE_MOVE)


@register("tree_copy")
def tree_copy(spark, sf_dir):
    return H.copy_subtree(_numbered(spark, sf_dir), *TREE_COPY)


@register("tree_edits")
def tree_edits(spark, sf_dir):
    return EL.apply_edits(_numbered(spark, sf_dir), TREE_EDITS)


@register("tree_rules")
def tree_rules(spark, sf_dir):
    rules = spark.createDataFrame(TREE_RULES, H.RULES_SCHEMA)
    return H.check_rules(_numbered(spark, sf_dir), rules)


@register("tree_dupes")
def tree_dupes(spark, sf_dir):
    return H.duplicate_siblings(_numbered(spark, sf_dir))


@register("catalog_dupes")
def catalog_dupes(spark, sf_dir):
    """A10 / H16 on the part catalogue hierarchy, where item titles repeat under a brand."""
    return H.duplicate_siblings(H.catalog_tree(spark, sf_dir))


@register("catalog_numbering")
def catalog_numbering(spark, sf_dir):
    """H10 on the part catalogue hierarchy (root -> type -> brand -> item)."""
    return H.number_tree(H.catalog_tree(spark, sf_dir))


@register("tree_rollup")
def tree_rollup(spark, sf_dir):
    flags = T.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 100).cast("long").alias("id"), (F.col("c_acctbal") > 0).alias("checked"))
    return H.rollup_checked(_numbered(spark, sf_dir), flags)


@register("tree_sorted")
def tree_sorted(spark, sf_dir):
    return H.sort_siblings(_numbered(spark, sf_dir))


@register("tree_sorted_by")
def tree_sorted_by(spark, sf_dir):
    """G5 + O8: siblings by a key of the caller's: longest title first."""
    return H.sort_siblings(_numbered(spark, sf_dir), -F.char_length("title"))


TREE_NODE = 11


@register("tree_children")
def tree_children(spark, sf_dir):
    """H2 + O5 + A8: the children of a node in order, with their own number of children."""
    t = _numbered(spark, sf_dir)
    return H.children(t, 3).select("id", "position", "title").join(H.children_counts(t), "id")


@register("tree_subtree_sizes")
def tree_subtree_sizes(spark, sf_dir):
    """A7 + F12: nodes below each node, and whether it is a leaf."""
    t = _numbered(spark, sf_dir)
    return t.select("id", H.subtree_size(t).alias("n_nodes"), H.is_leaf().alias("leaf"))


@register("tree_dump")
def tree_dump(spark, sf_dir):
    """S7 + H14 + X20: the indented lines of the tree in left order."""
    return H.dump(_numbered(spark, sf_dir))


@register("tree_search_with_parents")
def tree_search_with_parents(spark, sf_dir):
    """F10 + U2: the hits and their ancestors."""
    return H.search_with_ancestors(_numbered(spark, sf_dir), TREE_SEARCH)


@register("tree_subtree")
def tree_subtree(spark, sf_dir):
    """H3 for asked nodes only."""
    t = _numbered(spark, sf_dir)
    return H.descendants(t, t.where(F.col("id").isin(2, TREE_NODE)))


@register("tree_localized")
def tree_localized(spark, sf_dir):
    """Titles in one language where a node has one."""
    t = H.tree_from_tables(spark, sf_dir)
    titles = t.where("id % 3 = 0").select("id", F.lit("fr").alias("lang"), F.concat(F.lit("Le "), F.lower("title")).alias("title"))
    return H.localized_titles(t, titles, "fr").select("id", "title")


@register("tree_edits_checked")
def tree_edits_checked(spark, sf_dir):
    """G7 + H18: the edit log with a check, a Column over the log, that refuses to copy and to remove."""
    return EL.apply_edits(_numbered(spark, sf_dir), TREE_EDITS, check=~F.col("op").isin("copy", "remove"))


@register("tree_json")
def tree_json(spark, sf_dir):
    return H.node_json(_numbered(spark, sf_dir))


# ---------------------------------------------------------------- text analysis


def _docs(spark, sf_dir, lang=None):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.where(F.col("lang") == lang) if lang else d


@register("tokens_fr")
def tokens_fr(spark, sf_dir):
    """T1, T4, T6, T7, T9 over French documents: term frequencies."""
    t = A.normalized_tokens(_docs(spark, sf_dir, "fr"), "doc_id", "text", "french")
    return A.term_frequencies(t)


@register("tokens_en")
def tokens_en(spark, sf_dir):
    """T1, T4, T8, T9 over English documents: term frequencies."""
    t = A.normalized_tokens(_docs(spark, sf_dir, "en"), "doc_id", "text", "english")
    return A.term_frequencies(t)


@register("tokens_timestamped")
def tokens_timestamped(spark, sf_dir):
    """T3 + French filters (no stemmer) over conversation turns."""
    c = T.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")
    return A.term_frequencies(A.normalized_tokens(c, "doc_id", "text", "timestamped_french"))


@register("doc_phonetic")
def doc_phonetic(spark, sf_dir):
    """general analyzer (T1, T4, T9, T11 injected): term and code frequencies per document."""
    return A.analyzed_terms(_docs(spark, sf_dir), "doc_id", "text", "general")


@register("stem_vocab")
def stem_vocab(spark, sf_dir):
    """The stemming vocabulary of French and English documents."""
    out = None
    for lang, analyzer in (("fr", "french"), ("en", "english")):
        t = A.normalized_tokens(_docs(spark, sf_dir, lang), "doc_id", "text", analyzer)
        v = A.stem_vocabulary(t, "term", analyzer).withColumn("lang", F.lit(lang))
        out = v if out is None else out.unionByName(v)
    return out


@register("french_analyzer_tokens")
def french_analyzer_tokens(spark, sf_dir):
    """The full french_analyzer (with stemmer and phonetic codes) as a token index."""
    return A.analyzed_terms(_docs(spark, sf_dir, "fr"), "doc_id", "text", "french")


@register("english_analyzer_tokens")
def english_analyzer_tokens(spark, sf_dir):
    """The English analyzer over English documents."""
    return A.analyzed_terms(_docs(spark, sf_dir, "en"), "doc_id", "text", "english")


@register("tokens_timestamped_en")
def tokens_timestamped_en(spark, sf_dir):
    """T3 + English filters (no stemmer) over all documents."""
    return A.term_frequencies(A.counted_terms(_docs(spark, sf_dir), "doc_id", "text", "timestamped_english"))


@register("index_fields")
def index_fields(spark, sf_dir):
    """One inverted index over two text fields."""
    return A.indexed_terms(_docs(spark, sf_dir), "doc_id", ["text", "source"], "general")


def upserted_index(spark, sf_dir) -> TextIndex:
    """The documents indexed in three batches: all of them, a third in an older state; the true state of that third; some
    taken out and some sent again unchanged."""
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uuid"), "text", "source")
    index = TextIndex(spark, scratch_path(spark, f"index/{_uuid.uuid4().hex}"), ["text", "source"])
    third = F.col("uuid") % 3 == 0
    index.upsert(d.withColumn("text", F.when(third, F.concat_ws(" ", "source", "source")).otherwise(F.col("text"))), 0)
    index.upsert(d.where(third), 1)
    index.upsert(d.where(F.col("uuid") % 10 < 2), 2, delete=F.col("uuid") % 10 == 1)
    return index


@register("index_upserts")
def index_upserts(spark, sf_dir):
    """T14 with maintenance: document frequencies kept as differences, and occurrences, after the upserts."""
    index = upserted_index(spark, sf_dir)
    places = index.postings().groupBy("field", "term").agg(F.sum(F.size("positions")).alias("occurrences"))
    return index.frequencies().join(places, ["field", "term"])


PHRASE = "de la"


@register("index_phrase")
def index_phrase(spark, sf_dir):
    """T14 positions: documents that hold a phrase, found in the index after the upserts and a compaction."""
    index = upserted_index(spark, sf_dir)
    index.compact()
    return index.phrase("text", PHRASE)


@register("keyword_topk")
def keyword_topk(spark, sf_dir):
    """A9 over all documents, at most 20 a document."""
    return A.keyword_topk(A.counted_terms(_docs(spark, sf_dir), "doc_id", "text", "french"), 20)


@register("trend_keywords")
def trend_keywords(spark, sf_dir):
    """T2 + T4 + T5: keyword facet counts (each keyword whole, lower-cased, once per document)."""
    d = _docs(spark, sf_dir).select("doc_id", X.keyword_terms(
        F.array("source", "lang", F.upper(F.col("lang")))).alias("kw"))
    return (d.select("doc_id", F.explode("kw").alias("keyword"))
             .groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs")))


@register("fold_ascii")
def fold_ascii(spark, sf_dir):
    """X1 (fixed Latin-1 table, deletes the rest) and T9 (folding, keeps the rest) over whole texts."""
    d = _docs(spark, sf_dir)
    x1 = X.latin1_to_ascii(F.col("text"))
    t9 = X.ascii_fold(F.col("text"))
    return d.select("doc_id", F.length(x1).cast("bigint").alias("x1_len"), F.md5(x1).alias("x1_md5"),
                    F.length(t9).cast("bigint").alias("t9_len"), F.md5(t9).alias("t9_md5"))


# ---------------------------------------------------------------- names


SEARCH_QUERY = "red wi"        # F3 + F4: "red" analyzed, "wi*" as prefix
TYPEAHEAD_QUERY = "ld"


def _name_lists(spark, sf_dir):
    """Roll-call style name lists built from part rows: honorifics, a (...) suffix,
    ' et ' and a trailing dot, one misspelt name and one non-member per list."""
    p = T.table(spark, sf_dir, "part")
    txt = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("M. ")).otherwise(F.lit("MM. ")),
                   F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit("), Mme "),
                   F.replace(F.col("p_name"), F.lit("o"), F.lit("au")),
                   F.lit(" et M. "), F.lower(F.col("p_type")), F.lit("."))
    return p.select("p_partkey", txt.alias("names_text"))


@register("clean_names")
def clean_names(spark, sf_dir):
    """X7 + X2: split each list and clean each name; empty entries dropped."""
    lists = _name_lists(spark, sf_dir)
    names = F.transform(X.split_names(F.col("names_text")),
                        lambda raw, i: F.struct((i + 1).cast("long").alias("ord"),
                                                X.clean_name(raw).alias("name")))
    return lists.select("p_partkey", F.inline(F.filter(names, lambda n: n["name"] != "")))


@register("name_resolution")
def name_resolution(spark, sf_dir):
    """J1 + W5 + T*: every distinct cleaned name resolved against the name directory."""
    mentions = clean_names(spark, sf_dir).select(F.col("name").alias("mention"))
    return R.resolve_names(mentions, T.name_directory(spark, sf_dir))


@register("prefix_search_highlight")
def prefix_search_highlight(spark, sf_dir):
    return R.search(T.name_directory(spark, sf_dir), SEARCH_QUERY, R.SEARCH_CAP)


@register("search_stop_word_head")
def search_stop_word_head(spark, sf_dir):
    """F3 + F4: a head that the analyzer empties asks for nothing; one index serves several searches."""
    index = R.DirectoryIndex(T.name_directory(spark, sf_dir))
    first = R.search(index, "le " + SEARCH_QUERY.split()[1]).withColumn("q", F.lit("stop word"))
    return first.unionByName(R.search(index, "le " + SEARCH_QUERY).withColumn("q", F.lit("stop word and term")))


HOOK_QUERY = "e"


@register("typeahead_rank")
def typeahead_rank(spark, sf_dir):
    items = (T.name_directory(spark, sf_dir).groupBy(F.col("name").alias("item"))
             .agg(F.min("uuid").alias("input_order")))
    return R.typeahead(items, TYPEAHEAD_QUERY, R.TYPEAHEAD_ROWS)


@register("typeahead_hooks")
def typeahead_hooks(spark, sf_dir):
    """The typeahead with its three hooks replaced: items that end in the query, shortest first, the ending in brackets."""
    items = (T.name_directory(spark, sf_dir).groupBy(F.col("name").alias("item"))
             .agg(F.min("uuid").alias("input_order")))
    return R.typeahead(items, HOOK_QUERY, R.TYPEAHEAD_ROWS, matcher=lambda item, q: item.endswith(q),
                       sorter=lambda item, q: F.char_length(item), highlighter=lambda item, q: F.regexp_replace(item, f"({q})$", "[$1]"))


# ---------------------------------------------------------------- keyed tables


EVENT_KEY, EVENT_ORDER = ["user_id"], ["ts", "event_id"]


@register("upsert_latest")
def upsert_latest(spark, sf_dir):
    """K1 + U4: a snapshot from part of the change feed, then the rest applied as one batch."""
    ev = T.table(spark, sf_dir, "events")
    first = ev.where(F.col("event_type").isin("view", "click"))
    rest = ev.where(~F.col("event_type").isin("view", "click") | F.col("event_type").isNull())
    return U.upsert(U.latest_per_key(first, EVENT_KEY, EVENT_ORDER), rest, EVENT_KEY, EVENT_ORDER)


@register("keyed_replace")
def keyed_replace(spark, sf_dir):
    """U4: the latest rows of one part of the feed replace those of another with the same key."""
    ev = T.table(spark, sf_dir, "events")
    first = U.latest_per_key(ev.where(F.col("event_type").isin("view", "click")), EVENT_KEY, EVENT_ORDER)
    rest = U.latest_per_key(ev.where(F.col("event_type") == "purchase"), EVENT_KEY, EVENT_ORDER)
    return U.keyed_replace(first, rest, EVENT_KEY)


@register("record_routing")
def record_routing(spark, sf_dir):
    """K3 + F8: mixed records routed by type; what is neither passes through."""
    kinds = (("supplier", "s_suppkey", "deputy"), ("orders", "o_orderkey", "scrutiny"), ("part", "p_partkey", "page"))
    records = None
    for table, key, kind in kinds:
        part = T.table(spark, sf_dir, table).select(F.lit(kind).alias("record_type"), F.col(key).cast("long").alias("key"))
        records = part if records is None else records.unionByName(part)
    out = None
    for branch, rows in U.route_by_type(records).items():
        part = rows.select(F.lit(branch).alias("branch"), "record_type", "key")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("branch", "record_type").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("key_sum"))


@register("result_page_json")
def result_page_json(spark, sf_dir):
    """O9 + P21 + K4 + G3: one page of deputies, asked fields only, as JSON lines, through a pipeline of steps."""
    steps = [lambda d: P.page(d, [F.col("name").desc(), "uuid"], 20, 15), lambda d: P.project_fields(d, "uuid,name, party"), P.json_lines]
    return P.apply_pipeline(T.deputies(spark, sf_dir), steps)


@register("upsert_stream")
def upsert_stream(spark, sf_dir):
    """R1 + R2: the change feed read as a stream, applied per micro-batch with foreachBatch."""
    # a glob, so the file source watches the folder for this table's files
    path = f"{sf_dir.rstrip('/')}/event[s].parquet"
    schema = T.table(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = scratch_path(spark, f"upsert_stream/{_uuid.uuid4().hex}")
    table = U.DeltaKeyedTable(spark, f"{run}/table", EVENT_KEY, EVENT_ORDER)
    U.stream_upsert(spark, src, table, f"{run}/checkpoint")
    return table.current()


def _deputy_card(df):
    """G1 row callback of the rebuild: derived image path (P19) and profile slug (P20)."""
    return (df.withColumn("image", B.thumbnail_path(F.col("uuid")))
              .withColumn("slug", U.slug(F.col("name"))))


@register("rebuild_snapshot")
def rebuild_snapshot(spark, sf_dir):
    """K6 + G1: versioned rebuild of the deputies table through a row callback."""
    base = scratch_path(spark, f"rebuild/{_uuid.uuid4().hex}")
    return U.rebuild(T.deputies(spark, sf_dir), "deputies", _deputy_card, base=base)


# ---------------------------------------------------------------- pages


ALLOWED_DOMAIN = "example.com"   # S3: off-site links are flagged


def _pages(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", "url", "html")


@register("page_links")
def page_links(spark, sf_dir):
    """P1 link part + X10 + X11 + S3: every anchor of every page, resolved and split."""
    p = _pages(spark, sf_dir)
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(X.LINK_PATTERN), 1)
    ex = p.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    href = F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))
    absu = X.url_join(F.col("url"), href)
    return ex.select("page_id", F.col("pos").cast("bigint").alias("pos"), href.alias("href"),
                     absu.alias("abs_url"), X.url_host(absu).alias("host"),
                     X.on_domain(absu, F.lit(ALLOWED_DOMAIN)).alias("on_site"),
                     X.path_segment(absu, 1).alias("seg1"), X.path_segment(absu, -1).alias("last_seg"),
                     X.file_stem(absu).alias("stem"))


START_SECTIONS = ("de", "en")  # first path segment of the start pages


@register("page_frontier")
def page_frontier(spark, sf_dir):
    """S1 + S2: URLs reached from the start pages of two sections by links that stay on the allowed domain."""
    on_site = X.on_domain(F.col("url"), F.lit(ALLOWED_DOMAIN))
    return FR.reachable(_pages(spark, sf_dir), on_site & X.path_segment(F.col("url"), 1).isin(*START_SECTIONS), on_site)


@register("rollcall_frontier")
def rollcall_frontier(spark, sf_dir):
    """S1 + S2 on the legislature's pages: from the index pages to vote and info pages, every URL with its depth."""
    pages = RP.rollcall_pages(spark, sf_dir)
    return FR.reachable(pages, X.path_segment(F.col("url"), 2) == "documents")


@register("page_meta")
def page_meta(spark, sf_dir):
    """<meta name content> of the head as a JSON map per page, last duplicate wins."""
    p = _pages(spark, sf_dir)
    head = F.regexp_extract(F.col("html"), X.HEAD_PATTERN, 1)
    ex = p.select("page_id", F.posexplode(F.regexp_extract_all(head, F.lit(X.META_PATTERN), 0)).alias("pos", "tag"))
    kv = ex.select("page_id", "pos",
                   F.regexp_extract("tag", r"""(?i)\bname\s*=\s*"([^"]*)\"""", 1).alias("name"),
                   F.regexp_extract("tag", r"""(?i)\bcontent\s*=\s*"([^"]*)\"""", 1).alias("content"))
    last = (kv.where(F.col("name") != "").groupBy("page_id", "name")
              .agg(F.max_by("content", "pos").alias("content")))
    per = last.groupBy("page_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "content")))).alias("m"),
        F.count(F.lit(1)).alias("n_meta"))
    return (p.select("page_id").join(per, "page_id", "left")
             .select("page_id", F.coalesce(F.to_json("m"), F.lit("{}")).alias("meta_json"),
                     F.coalesce("n_meta", F.lit(0)).cast("bigint").alias("n_meta")))


@register("page_blocks")
def page_blocks(spark, sf_dir):
    """P4 + P9 + D1/D2: paragraphs of every page (class, #analyse flag, text), with the page date."""
    f = E.facts(_pages(spark, sf_dir))
    return f.select("page_id", E.page_date(f).alias("page_date"), F.inline("paragraphs")) \
            .select("page_id", "page_date", "pos", "cls", "in_analyse", "txt")


@register("page_join_chain")
def page_join_chain(spark, sf_dir):
    """J2 + P1 + P3-P8: roll calls extracted from index -> vote -> info pages."""
    s, _, _ = E.scrutinies_from_pages(_pages(spark, sf_dir))
    return s


@register("rollcall_extract")
def rollcall_extract(spark, sf_dir):
    """W1/W2 + X2/X7 + F6 + F7: named ballots extracted from vote pages."""
    _, b, _ = E.scrutinies_from_pages(_pages(spark, sf_dir))
    return b


@register("deputy_profiles")
def deputy_profiles(spark, sf_dir):
    """P12-P14 + S4: deputy profiles from member pages, parser chosen by legislature."""
    deps, _ = E.deputies_from_pages(_pages(spark, sf_dir))
    return deps


@register("tree_xml_roundtrip")
def tree_xml_roundtrip(spark, sf_dir):
    """K5 + S9: the numbered tree exported as flat XML items, read back and renumbered."""
    path = scratch_path(spark, f"tree_xml/{_uuid.uuid4().hex}")
    TF.write_flat_xml(_numbered(spark, sf_dir), path)
    return H.number_tree(TF.read_flat_xml(spark, path))

"""Roll-call operators over the flat ``ballots`` table.

The reference keeps votes nested in one document per roll call and recounts
them in Python per page view. Here the flat table is the primary form (it
prunes and pushes filters into parquet) and every operator is one set-based
job over all roll calls or all deputies at once:

* tallies (A1) and per-group tallies (A2) are hash aggregates with a map-side
  partial step, so a roll call holding a third of all ballots is reduced per
  input partition before the shuffle;
* per-deputy history (W6/O1) is ``row_number() <= k``, which Spark plans as a
  partial WindowGroupLimit before the exchange and a final one after it, so a
  hot deputy ships at most k rows per map partition;
* the nested document (P17) is a sink shape only, built from bounded lists in page order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.text import capitalize
from hemicycle.plans.ranking import rank_in_groups
from hemicycle.streaming.upsert import keyed_replace

__all__ = ["capitalize"]

# Labels shown by the reference's templates.
STANCE_FOR, STANCE_AGAINST, STANCE_ABSTAINED = "Pour", "Contre", "Abstenu"
OUTCOME_ADOPTED, OUTCOME_REJECTED = "Adopté", "Rejeté"
VOTE_LABELS = {"yea": "Pour", "nay": "Contre", "abs": "Abstenu"}

HISTORY_CAP = 1000  # the reference's result size per (deputy, vote type)


# --------------------------------------------------------------------------
# scalar helpers
# --------------------------------------------------------------------------

def outcome(yea: Column, nay: Column) -> Column:
    """Adopted iff yea >= nay (0-0 is adopted)."""
    return F.when(yea >= nay, F.lit(OUTCOME_ADOPTED)).otherwise(F.lit(OUTCOME_REJECTED))


def stance(yea: Column, nay: Column, abs_: Column) -> Column:
    """Group stance; ties and all-zero are 'Contre'."""
    return (F.when(yea > nay, F.lit(STANCE_FOR))
             .when((nay == 0) & (abs_ > 0), F.lit(STANCE_ABSTAINED))
             .otherwise(F.lit(STANCE_AGAINST)))


def vote_label(vote: Column) -> Column:
    """yea/nay/abs -> Pour/Contre/Abstenu."""
    m = F.create_map(*[F.lit(x) for kv in VOTE_LABELS.items() for x in kv])
    return m[vote]


def display_date(ts: Column) -> Column:
    """ISO timestamp -> dd/MM/yyyy."""
    return F.date_format(ts, "dd/MM/yyyy")


def list_length(arr: Column) -> Column:
    """Length of a possibly missing list, missing -> 0."""
    return F.coalesce(F.size(arr), F.lit(0))


def _count_vote(v: str) -> Column:
    return F.count_if(F.col("vote") == v).cast("bigint").alias(v)


# --------------------------------------------------------------------------
# aggregates
# --------------------------------------------------------------------------

def tallies(ballots: DataFrame) -> DataFrame:
    """A1 + X16: yea / nay / abs per roll call; unresolved voters still count."""
    return (ballots.groupBy("scrutiny_uuid")
                   .agg(_count_vote("yea"), _count_vote("nay"), _count_vote("abs"))
                   .withColumn("outcome", outcome(F.col("yea"), F.col("nay"))))


def with_group(ballots: DataFrame, deputies: DataFrame) -> DataFrame:
    """Attach the voter's group. Left join: a voter without a deputy row keeps a null group."""
    d = deputies.select(F.col("uuid").alias("voter_uuid"), F.col("party").alias("group_name"))
    return ballots.join(d, "voter_uuid", "left")


def group_tallies(ballots_g: DataFrame) -> DataFrame:
    """A2 + X15: tallies per (roll call, group); a missing vote type is 0."""
    return (ballots_g.groupBy("scrutiny_uuid", "group_name")
                     .agg(_count_vote("yea"), _count_vote("nay"), _count_vote("abs"))
                     .withColumn("stance", stance(F.col("yea"), F.col("nay"), F.col("abs"))))


def voter_totals(ballots: DataFrame) -> DataFrame:
    """Number of distinct roll calls per (deputy, vote type).

    A deputy listed twice in one roll call counts once (documents, not ballots).
    """
    return (ballots.where(F.col("voter_uuid").isNotNull())
                   .groupBy("voter_uuid", "vote")
                   .agg(F.count_distinct("scrutiny_uuid").alias("n_scrutinies")))


def voter_history(ballots: DataFrame, scrutinies: DataFrame, k: int = HISTORY_CAP) -> DataFrame:
    """W6 + O1 + J4 + D4: each deputy's roll calls per vote type, latest first, capped at k.

    Output per row: the deputy, the vote type, the roll call, its display date,
    its rank, and the roll call's tallies and outcome (the deputy page).
    Ties on date are broken by roll-call key; missing dates sort last.
    """
    docs = (ballots.where(F.col("voter_uuid").isNotNull())
                   .select("voter_uuid", "vote", "scrutiny_uuid").distinct())
    # per-roll-call facts (tallies, date) are joined before ranking: one
    # shuffle of the history by roll call, then one by deputy for the window
    info = tallies(ballots).join(scrutinies.select("scrutiny_uuid", "date"), "scrutiny_uuid", "left")
    w = Window.partitionBy("voter_uuid", "vote").orderBy(F.col("date").desc_nulls_last(),
                                                          F.col("scrutiny_uuid"))
    ranked = (docs.join(info, "scrutiny_uuid")
                  .withColumn("rn", F.row_number().over(w))
                  .where(F.col("rn") <= k))
    return (ranked
                  .select("voter_uuid", "vote", "scrutiny_uuid",
                          display_date(F.col("date")).alias("date_display"),
                          F.col("rn").cast("bigint").alias("rn"),
                          "yea", "nay", "abs", "outcome"))


# --------------------------------------------------------------------------
# nested document form
# --------------------------------------------------------------------------

LIST_CHUNK = 10_000  # voters per list of a document part: the parts of a roll call hold its lists in page order


def nest_votes(ballots_g: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Flat ballots -> nested document parts
    ``(scrutiny_uuid, part, votes: array<struct<name, votes: struct<yea, nay, abs: array<voter>>>>)``.

    Every (roll call, group, vote) list is cut into chunks of ``chunk`` voters in page order (A4: ``ord``,
    then voter), nulls (unresolved voters) included; chunk i of every list goes to part i. Shape and meaning are the
    same at any size: joining the parts of a roll call in order gives its lists. The position comes from a
    skew-safe rank, so a roll call holding a third of all ballots is never sorted or collected in one task.
    """
    keys = ["scrutiny_uuid", "group_name", "vote"]
    ranked = rank_in_groups(ballots_g.select(*keys, "ord", "voter_uuid"), keys,
                            [F.col("ord").asc_nulls_last(), F.col("voter_uuid").asc_nulls_last()], "rn")
    parts = ranked.withColumn("part", F.floor((F.col("rn") - 1) / F.lit(chunk)).cast("long"))
    voter = F.struct("rn", "voter_uuid")
    lists = [F.array_sort(F.collect_list(F.when(F.col("vote") == v, voter))).alias(v) for v in ("yea", "nay", "abs")]
    per_group = parts.groupBy("scrutiny_uuid", "part", "group_name").agg(*lists)
    votes = F.struct(*[F.when(F.size(v) > 0, F.transform(v, lambda x: x["voter_uuid"])).alias(v) for v in ("yea", "nay", "abs")])
    entry = F.struct(F.col("group_name").alias("name"), votes.alias("votes"))
    return (per_group.groupBy("scrutiny_uuid", "part")
                     .agg(F.array_sort(F.collect_list(F.struct(F.col("group_name").alias("_k"), entry.alias("_e")))).alias("_v"))
                     .select("scrutiny_uuid", "part", F.transform("_v", lambda x: x["_e"]).alias("votes")))


def flatten_votes(nested: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """P18 + F6: nested votes -> one row per ballot (empty / missing lists vanish).

    ``list_pos`` is the position in the whole list, across parts.
    """
    groups = nested.select("scrutiny_uuid", "part", F.inline("votes"))
    by_type = groups.select(
        "scrutiny_uuid", "part", F.col("name").alias("group_name"),
        F.expr("stack(3, 'yea', votes.yea, 'nay', votes.nay, 'abs', votes.abs) as (vote, voters)"))
    return (by_type.select("scrutiny_uuid", "part", "group_name", "vote", F.posexplode("voters").alias("pos", "voter_uuid"))
            .select("scrutiny_uuid", "group_name", "vote", (F.col("part") * chunk + F.col("pos")).alias("list_pos"), "voter_uuid"))


def nested_tallies(nested: DataFrame) -> DataFrame:
    """A1 computed directly on the nested form: sum of list lengths, nulls included."""
    def total(v: str) -> Column:
        return F.aggregate(F.col("votes"), F.lit(0).cast("bigint"),
                           lambda acc, g: acc + list_length(g["votes"][v]))
    per_part = nested.select("scrutiny_uuid", *[total(v).alias(v) for v in ("yea", "nay", "abs")])
    return per_part.groupBy("scrutiny_uuid").agg(*[F.sum(v).cast("bigint").alias(v) for v in ("yea", "nay", "abs")])


def filter_voted(nested: DataFrame, voter_uuid, vote: str) -> DataFrame:
    """document parts whose ``vote`` lists contain the deputy, on the nested form.

    ``array_contains`` over a list holding nulls yields NULL rather than false;
    the coalesce keeps the predicate two-valued.
    """
    return nested.where(F.exists("votes", lambda g: F.coalesce(
        F.array_contains(g["votes"][vote], F.lit(voter_uuid)), F.lit(False))))


def voted_pairs(nested: DataFrame, deputies: DataFrame) -> DataFrame:
    """F1 for every deputy at once: distinct (deputy, vote type, roll call) found in the lists."""
    found = None
    for v in ("yea", "nay", "abs"):
        ids = F.array_distinct(F.flatten(F.transform("votes", lambda g: F.coalesce(
            g["votes"][v], F.array().cast("array<bigint>")))))
        part = nested.select("scrutiny_uuid", F.lit(v).alias("vote"), F.explode(ids).alias("voter_uuid"))
        found = part if found is None else found.unionByName(part)
    d = deputies.select(F.col("uuid").alias("voter_uuid"))
    return found.select("voter_uuid", "vote", "scrutiny_uuid").distinct().join(d, "voter_uuid", "left_semi")


# --------------------------------------------------------------------------
# random pick
# --------------------------------------------------------------------------

def thumbnail_path(uuid: Column) -> Column:
    """Static image path of a deputy."""
    return F.concat(F.lit("img/thumbs/"), uuid.cast("string"), F.lit(".jpg"))


def random_pick(deputies: DataFrame, seed: int = 20, score: Column | None = None) -> DataFrame:
    """O2: one deputy by a random score over the whole table (F2: match all).

    The default score is an MD5 of the key and the seed, so the pick is
    reproducible (and checkable against any SQL engine); any Column can be
    passed as the score (G6). ``orderBy().limit(1)`` plans as
    TakeOrderedAndProject: a per-partition top-1, then a merge of one row per
    partition.
    """
    sc = score if score is not None else F.md5(F.concat(F.col("uuid").cast("string"), F.lit(f":{seed}")))
    return (deputies.withColumn("_score", sc)
                    .orderBy(F.col("_score"), F.col("uuid")).limit(1)
                    .drop("_score")
                    .withColumn("image", thumbnail_path(F.col("uuid"))))


# --------------------------------------------------------------------------
# documents and point lookups
# --------------------------------------------------------------------------

# The document fields the reference writes for a roll call.
SCRUTINY_FIELDS = ("uuid", "title", "date", "url", "leg", "num", "keywords", "file_href", "info",
                   "amendments")


def scrutiny_documents(scrutinies: DataFrame, ballots_g: DataFrame, strict: bool = False,
                       chunk: int = LIST_CHUNK, parts: int | None = None) -> DataFrame:
    """K2: whitelisted roll-call fields plus the nested ``votes`` array, one row per (uuid, part).

    A roll call without ballots has part 0 with null votes. ``replace_documents`` stores them: the parts
    of a uuid are replaced together.

    ``strict`` keeps only the reference's 10 fields (``summary`` dropped, P15);
    otherwise ``summary`` and ``law_href`` are kept too. Missing fields are null. ``parts``: partitions of the join by
    roll call (default: the session's).
    """
    keep = list(SCRUTINY_FIELDS) + ([] if strict else ["summary", "law_href"])
    cols = [F.col(c) if c in scrutinies.columns else F.lit(None).alias(c) for c in keep]
    docs = scrutinies.select(*cols)
    nested = nest_votes(ballots_g, chunk).withColumnRenamed("scrutiny_uuid", "uuid")
    if parts:
        docs, nested = docs.repartition(parts, "uuid"), nested.repartition(parts, "uuid")
    return docs.join(nested, "uuid", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """K1 + U4 on document parts: a uuid in ``new`` replaces all parts it had in ``old``."""
    return keyed_replace(old, new, ["uuid"])


def get_deputy(deputies: DataFrame, uuid) -> DataFrame:
    """Point lookup by key (pushed into the scan); empty when missing."""
    return deputies.where(F.col("uuid") == F.lit(uuid)).withColumn("image", thumbnail_path(F.col("uuid")))


def deputy_page(deputies: DataFrame, ballots: DataFrame, scrutinies: DataFrame, uuid,
                k: int = HISTORY_CAP) -> tuple[DataFrame, DataFrame]:
    """J3 + J4 for one deputy: (profile, history by vote type with tallies, latest first)."""
    b = ballots.where(F.col("voter_uuid") == F.lit(uuid))
    roll_calls = b.select("scrutiny_uuid").distinct()
    all_b = ballots.join(roll_calls, "scrutiny_uuid", "left_semi")
    hist = voter_history(all_b, scrutinies, k).where(F.col("voter_uuid") == F.lit(uuid))
    return get_deputy(deputies, uuid), hist

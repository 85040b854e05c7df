"""Name resolution (J1), prefix search with highlight (F3, F4, X18) on hand rows."""

import pytest

from hemicycle.operators import resolve as R


@pytest.fixture(scope="module")
def directory(spark):
    rows = [(1, "Jean Dupont"), (2, "Jean Durand"), (3, "Marie Dupont"), (4, "Jean Dupont"),
            (5, "Anne-Marie Lefèvre")]
    return spark.createDataFrame(rows, "uuid long, name string")


def resolve(spark, directory, mentions):
    m = spark.createDataFrame([(x,) for x in mentions], "mention string")
    return {r.mention: r.uuid for r in R.resolve_names(m, directory).collect()}


def test_exact_and_ties(spark, directory):
    got = resolve(spark, directory, ["Jean Dupont", "Marie Dupont"])
    assert got["Jean Dupont"] == 1          # uuid 1 and 4 tie: smallest uuid
    assert got["Marie Dupont"] == 3


def test_every_position_must_match(spark, directory):
    got = resolve(spark, directory, ["Jean Martin", "Dupont"])
    assert got["Jean Martin"] is None
    assert got["Dupont"] in (1, 3, 4)


def test_accents_phonetics_and_stop_words(spark, directory):
    got = resolve(spark, directory, ["anne-marie lefevre", "Jean Dupond", "de la", ""])
    assert got["anne-marie lefevre"] == 5   # folding
    assert got["Jean Dupond"] in (1, 4)     # refined Soundex: dupond ~ dupont
    assert got["de la"] is None             # only stop words: no query, no match
    assert got[""] is None


def test_prefix_search_highlight(spark, directory):
    hits = R.search(directory, "jean dur").collect()
    assert [h.uuid for h in hits] == [2]
    assert hits[0].name_highlight == "<strong>Jean</strong> <strong>Durand</strong>"
    # the starred word is matched against indexed stems without being stemmed
    # itself: "marie" is indexed as "mar", so "marie*" finds nothing, "mar*" both
    assert R.search(directory, "marie").count() == 0
    assert {h.uuid for h in R.search(directory, "mar").collect()} == {3, 5}


def test_stop_word_before_the_prefix(spark, directory):
    """A head of stop words only asks for nothing, and an index serves many searches."""
    index = R.DirectoryIndex(directory)
    assert {h.uuid for h in R.search(index, "le dur").collect()} == {h.uuid for h in R.search(index, "dur").collect()} == {2}
    assert [h.uuid for h in R.search(index, "le jean dur").collect()] == [2]


def test_every_entry_of_a_name_is_found(spark, directory):
    assert {h.uuid for h in R.search(directory, "jean dup").collect()} == {1, 4}

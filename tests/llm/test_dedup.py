"""Exact, near-duplicate and passage deduplication."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from hemicycle.llm import exact_dedup, minmax_dedup, substring_dedup
from hemicycle.llm.components import components
from tests.llm import brute


def test_exact_report(docs):
    groups = {}
    for r in docs.collect():
        h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text).encode()).hexdigest()
        groups.setdefault(h, []).append((-len(r.text), r.doc_id))
    rows = exact_dedup.report(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        g = groups[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (min(g)[1], len(g), min(g)[1] == r.doc_id)


def test_exact_saturated_filter_stays_right(docs):
    """One block of bits for all rows: nearly everything is shuffled, the result is the same."""
    small = exact_dedup.decide(docs, bits_per_row=1, max_bits=1)
    a = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in small.collect()}
    b = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(docs).collect()}
    assert a == b


def test_exact_filter_passes_single_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3900).cast("string")).alias("text"))
    done = exact_dedup.Decisions(df)
    passed = done.marked.filter("maybe").count()
    assert 200 <= passed < 1000  # 200 rows are repeated
    assert exact_dedup.deduplicate(df).count() == 3900


def test_exact_odd_rows(odd, none):
    rows = exact_dedup.report(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and [r.doc_id for r in empty if r.kept] == [5]  # the longest original stays
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert exact_dedup.report(none).collect() == [] and exact_dedup.deduplicate(none).collect() == []


def test_exact_plan_is_native(docs):
    plan = exact_dedup.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_near_matches_brute_force(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    for width in (2, 5):
        sets = [brute.shingle_set(r.text, width) for r in rows]
        want = brute.components(sets)
        got = {r.doc_id: r for r in minmax_dedup.report(docs, width).collect()}
        for i, r in enumerate(rows):
            g = got[r.doc_id]
            assert (g.n_shingles, g.component_id) == (len(sets[i]), rows[want[i]].doc_id)
            assert g.kept == (r.doc_id == g.component_id)


def test_near_chains_and_threshold(spark):
    """Families of edited texts around the threshold, against brute force."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 12, 60, 200)))]
        for _ in range(10):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000 + family * 1000, " ".join(text)))
    rows.sort()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.components([brute.shingle_set(t, 2) for _, t in rows])
    got = {r.doc_id: r.component_id for r in minmax_dedup.report(df, 2).collect()}
    assert got == {rows[i][0]: rows[w][0] for i, w in enumerate(want)}


def test_minmax_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    xor, mul = minmax_dedup.seeded(400, 101), minmax_dedup.seeded(400, 102) | np.uint64(1)
    pool = rng.integers(1, 1 << 63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[250:1250])  # similarity 0.6
    same = minmax_dedup.signature(a, xor, mul) == minmax_dedup.signature(b, xor, mul)
    assert abs(same[::2].mean() - 0.6) < 0.08 and abs(same[1::2].mean() - 0.6) < 0.08


def test_near_odd_rows(odd, none):
    rows = minmax_dedup.report(odd, 2).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(map(str, by[1])) == sorted(map(str, [1, 1, 2, None]))
    assert sorted(by[7]) == [7, 8] and sorted(by[6]) == [6, 11]
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    kept = minmax_dedup.deduplicate(odd, width=5)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, 5, 6, 7, None, 9, 10]))
    assert minmax_dedup.report(none).collect() == [] and minmax_dedup.deduplicate(none).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 9), (9, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 560)} == {500}
    assert got[7] == got[8] == got[9] == 7
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, least = int(rng.integers(1, 50)), int(rng.integers(1, 10))
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        lo, c, hi = substring_dedup.compact_windows(h, np.array([0]), np.array([n - 1]), least)
        for a in range(n):
            for b in range(a + least - 1, n):
                at = [i for i in range(len(lo)) if lo[i] <= a <= c[i] <= b <= hi[i]]
                assert len(at) == 1 and c[at[0]] == a + int(np.argmin(h[a:b + 1]))


def check_passages(df):
    rows = df.collect()
    want = brute.repeated_words([r.text for r in rows])
    marked = [set() for _ in rows]
    place = {r.doc_id: i for i, r in enumerate(rows)}
    for r in substring_dedup.report(df).collect():
        marked[place[r.doc_id]].update(range(r.start_word, r.end_word))
        assert r.end_word - r.start_word >= substring_dedup.WORDS
    for i, mark in enumerate(want):
        if mark:
            assert marked[i], rows[i].doc_id
            assert len(mark - marked[i]) <= 0.02 * len(mark) + 10, rows[i].doc_id
    return rows, want, marked


def test_passages_match_brute_force(docs):
    check_passages(docs)


def test_passages_behind_a_common_line(spark):
    """A line in every text hides nothing: passages of 50 to 80 words around it are found, clean texts are left alone."""
    rnd = random.Random(5)
    word = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    line = word(20)
    texts = [[*word(60), *line, *word(60)] for _ in range(40)]
    for a, b, n in ((3, 20, 50), (4, 21, 65), (5, 22, 80)):
        passage = [*word(15), *line, *word(n - 35)]
        texts[a][60:80], texts[b][60:80] = passage, passage
    edited = [*texts[7][:40], "changed", *texts[7][41:]]
    texts.append(edited)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows, want, marked = check_passages(df)
    assert {r.doc_id for r, m in zip(rows, marked, strict=True) if m} == {3, 20, 4, 21, 5, 22, 7, 40}


def test_passages_odd_rows(odd, none):
    rows = substring_dedup.report(odd).collect()
    assert {r.doc_id for r in rows} == {7, 8} and {r.kind for r in rows} == {"near", "source"}
    assert max(r.end_word for r in rows) == 60_000
    assert substring_dedup.report(none).collect() == []
    twice = substring_dedup.report(odd.filter("doc_id = 7").unionByName(odd.filter("doc_id = 7"))).collect()
    assert [(r.kind, r.start_word, r.end_word) for r in twice] == [("copy", 0, 60_000)] * 2


def test_cells_are_cut_by_compact_windows():
    """The cells of a table are the Cartesian-tree windows of its functions, cut against each other."""
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    least = 12
    lo, c, hi = substring_dedup.compact_windows(h, np.array([0]), np.array([89]), least)
    at = brute.window_minima(h.tolist(), least)
    for s in range(90 - least + 1):
        (k,) = [k for k in range(len(lo)) if lo[k] <= s <= c[k] <= s + least - 1 <= hi[k]]
        assert at[s] == c[k]
    i, j, c = substring_dedup.windows_of_starts(h, np.array([0, 50]), np.array([49, 89]), least)
    place = [(s, a) for first, last, a in zip(i, j, c, strict=True) for s in range(first, last + 1)]
    assert place == [(s, at[s]) for s in range(90 - least + 1) if s + least <= 50 or s >= 50]
    owner, i, j, _, sig = substring_dedup.cells(h, np.array([0, 5, 50, 90]), least, tables=2, hashes=2)
    for t in range(2):
        mine = (sig & np.uint64(15)) == t
        covered = sorted((o, s) for o, a, b in zip(owner[mine], i[mine], j[mine], strict=True) for s in range(a, b + 1))
        assert covered == [(1, s) for s in range(45 - least + 1)] + [(2, s) for s in range(40 - least + 1)]


def test_aligned_windows_match_sets():
    """Similar aligned windows of sequences with and without repeated shingles, against sets."""
    rng = np.random.default_rng(4)
    n = substring_dedup.LENGTH
    seen = set()
    for values, changes in ((10 ** 9, 12), (10 ** 9, 2), (60, 12), (25, 6), (3, 40)):
        x = rng.integers(0, values, 150).astype(np.uint64)
        y = x.copy()
        y[rng.integers(0, 150, changes)] = rng.integers(0, values, changes)
        for a, b in ((x, y), (x, np.roll(y, 2)), (np.tile(x[:20], 8), np.tile(y[:20], 8))):
            got = substring_dedup._similar(a, b)
            for s in range(len(a) - n + 1):
                u, v = set(a[s:s + n].tolist()), set(b[s:s + n].tolist())
                assert got[s] == (100 * len(u & v) >= 80 * len(u | v))
                seen.add(bool(got[s]))
    assert seen == {True, False}


def test_stretches_are_compared_apart():
    """Aligned stretches handled at once, with shingles that recur in them, against each one's sets."""
    rng = np.random.default_rng(9)
    n = substring_dedup.LENGTH
    lengths = np.array([n, n + 7, n + 60, n + 1])
    x = rng.integers(0, 100, lengths.sum()).astype(np.uint64)
    y = np.where(rng.random(len(x)) < 0.87, x, rng.integers(0, 100, len(x)).astype(np.uint64))
    y[:n] = x[:n]
    want = []
    for a, b in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True):
        for s in range(a, b - n + 1):
            u, v = set(x[s:s + n].tolist()), set(y[s:s + n].tolist())
            want.append(100 * len(u & v) >= 80 * len(u | v))
    assert substring_dedup.similar_starts(x, y, lengths).tolist() == want and 0 < sum(want) < len(want)
    assert [v.tolist() for v in substring_dedup.joined(np.array([9, 1, 3, 20]), np.array([10, 2, 7, 21]))] == [[1, 9, 20], [7, 10, 21]]


def test_only_windows_that_can_be_similar_are_searched(spark):
    """The cells are those of the shared passages; the words around them and texts without any are left out."""
    df, at = planted(spark, random.Random(2), [60] * 20, 1)
    rnd = random.Random(4)
    clean = [(100 + k, " ".join(f"c{rnd.randrange(20_000)}" for _ in range(300))) for k in range(30)]
    found = substring_dedup.Passages(df.unionByName(spark.createDataFrame(clean, "doc_id long, text string")))
    searched = found.sequences.join(found.names, "row").collect()
    assert searched and {r.doc_id for r in searched} <= set(at)
    for r in searched:
        size = np.diff([*r["at"], len(r.words) // 4 + 1]) - 1
        for start, n in zip(r.real, size.tolist(), strict=True):
            assert n >= substring_dedup.WORDS and at[r.doc_id][0] - 10 <= start and start + n <= at[r.doc_id][1] + 10


def test_cells_of_texts_that_repeat_themselves():
    """A long text of one repeated line: every start lies in one cell, whose signature is that of the line's minima."""
    line = np.random.default_rng(2).integers(0, 1 << 63, 9).astype(np.uint64)
    g = np.tile(line, 4000)
    owner, i, j, c, sig = substring_dedup.cells(g, np.array([0, len(g)]), tables=2, hashes=2)
    for t in range(2):
        mine = (sig & np.uint64(15)) == t
        assert len(set(sig[mine].tolist())) == 1
        order = np.argsort(i[mine])
        first, last = i[mine][order], j[mine][order]
        assert first[0] == 0 and last[-1] == len(g) - substring_dedup.LENGTH and (first[1:] == last[:-1] + 1).all()


def planted(spark, rnd, sizes, changed):
    """Pairs of documents that share a passage with ``changed`` words replaced; (table, passages by document)."""
    word = lambda n: [f"v{rnd.randrange(20_000)}" for _ in range(n)]
    rows, at = [], {}
    for k, n in enumerate(sizes):
        passage = word(n)
        for d in (2 * k, 2 * k + 1):
            before = rnd.randrange(20, 80)
            body = list(passage)
            if d % 2:
                for place in rnd.sample(range(n), changed):
                    body[place] = "edited" + str(place)
            rows.append((d, " ".join([*word(before), *body, *word(rnd.randrange(20, 80))])))
            at[d] = (before, before + n)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), at


def test_passages_of_two_documents_are_always_found(spark):
    df, at = planted(spark, random.Random(11), [50 + k % 7 for k in range(300)], 0)
    marked = {d: set() for d in at}
    for r in substring_dedup.report(df).collect():
        marked[r.doc_id].update(range(r.start_word, r.end_word))
    assert all(set(range(*at[d])) <= marked[d] for d in at)


def similar_pair(x, y):
    """Brute force: whether an aligned pair of 50-word windows of two word lists has similarity 0.8 or more."""
    sets = [[{tuple(w[s + q:s + q + 5]) for q in range(46)} for s in range(len(w) - 49)] for w in (x, y)]
    return any(100 * len(u & v) >= 80 * len(u | v) for u, v in zip(*sets, strict=True))


def test_near_passages_recall(spark):
    """Of the pairs that hold a window pair at 0.8 or more by brute force, 97% or more are found."""
    for n, changed in ((50, 1), (60, 1), (60, 2), (80, 4), (120, 4)):
        df, at = planted(spark, random.Random(n + changed), [n] * 150, changed)
        text = {r.doc_id: r.text.split() for r in df.collect()}
        want = {d for d in at if d % 2 and similar_pair(text[d - 1][slice(*at[d - 1])], text[d][slice(*at[d])])}
        found = {r.doc_id for r in substring_dedup.report(df).collect() if r.kind in ("near", "exact")}
        found |= {d ^ 1 for d in found}
        assert len(want) >= 20 and len(want & found) >= 0.97 * len(want), (n, changed, len(want), len(want & found))


def test_passages_near_one_that_is_near_the_first(spark):
    """A ~ B ~ C where A and C are not similar: the link of B and C is found although B has met A."""
    rnd = random.Random(3)
    word = lambda n: [f"v{rnd.randrange(20_000)}" for _ in range(n)]
    texts, n = [], 100
    for _ in range(n):
        first = word(50)
        second = [*first[:15], "edited", *first[16:]]
        third = [*second[:32], "again", *second[33:]]
        assert similar_pair(first, second) and similar_pair(second, third) and not similar_pair(first, third)
        texts += [" ".join([*word(40), *body, *word(40)]) for body in (first, second, third)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links = {frozenset((r.doc_id, r.source_id)) for r in substring_dedup.report(df).collect()}
    assert sum(frozenset((3 * k + 1, 3 * k + 2)) in links for k in range(n)) >= 0.97 * n


def test_many_contents_under_one_signature(spark):
    """Cells of one signature are compared whatever their number; a content that a document repeats is found at each place."""
    rnd = random.Random(6)
    word = lambda n: [f"v{rnd.randrange(20_000)}" for _ in range(n)]
    texts = [word(50) for _ in range(30)]
    near = [*texts[29][:20], "edited", *texts[29][21:]]
    texts.append([*near, *near])
    p = substring_dedup.Passages.__new__(substring_dedup.Passages)
    p.spark = spark
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32).tobytes() for t in texts]
    p.sequences = spark.createDataFrame([(i, 0, bytearray(c)) for i, c in enumerate(codes)], "row long, start long, words binary")
    at = substring_dedup.packed(np.array([0, 50]), np.array([0, 50]), np.array([10, 60])).tolist()
    cells = [(i, True, 5, at[0], i) for i in range(31)] + [(30, True, 5, at[1], 30)]
    found = p._all_contents(spark.createDataFrame(cells, "row long, left boolean, sig long, at long, content long")).collect()
    assert sorted(map(tuple, found)) == [(30, 29, 0, 0, 0), (30, 29, 50, 50, 50)]

"""Language, quality, HTML blocks, benchmark leaks, packing, pipeline."""

import html
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hemicycle.llm import decontaminate, html_blocks, langid, packing, quality
from hemicycle.llm.queries import tokenizer_path

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def crc(x):
    return zlib.crc32(str(x).encode())


def test_langid_held_out(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.collect()}
    rows = langid.report(df).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_mixture_shares(docs):
    model = langid.train(docs)
    langs, p = model
    by = {r.lang: r.text for r in docs.orderBy("n_chars").collect()}
    mixed = (by["en"][:3000] + " " + by["de"][:1500]).encode()
    best, share, size = langid.infer(langid.trigram_counts(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)])), p)
    assert langs[best[0]] == "en" and 0.5 < share[0] < 0.85 and size[0] == 2


def plain_shares(c, p, allowed, rounds):
    """Proportions and log-likelihood by expectation maximisation, one trigram at a time."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(rounds):
        mass = dict.fromkeys(allowed, 0.0)
        for t, n in c.items():
            whole = sum(share[k] * p[k][t] for k in allowed)
            for k in allowed:
                mass[k] += n * share[k] * p[k][t] / whole
        share = {k: v / sum(c.values()) for k, v in mass.items()}
    return share, sum(n * np.log(sum(share[k] * p[k][t] for k in allowed)) for t, n in c.items())


def plain_set(c, p):
    """(largest language, its share among all, size of the set) of the best penalised likelihood over all nested sets."""
    full, _ = plain_shares(c, p, range(len(p)), langid.ITERATIONS)
    ranked = sorted(full, key=lambda k: (-full[k], k))
    scored = []
    for k in range(1, len(p) + 1):
        share, fit = plain_shares(c, p, ranked[:k], 1 if k == 1 else langid.ITERATIONS // 2)
        scored.append((fit - langid.PENALTY * (k - 1) * np.log(max(sum(c.values()), 2)), -k, max(share, key=share.get)))
    _, k, best = max(scored)
    return best, full[best], -k


def test_langid_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(5)
    p = rng.gamma(0.3, size=(6, langid.BUCKETS)) + 1e-4
    p = (p / p.sum(1, keepdims=True)).astype(np.float32)
    shares = [[1, 0, 0, 0, 0, 0], [.6, .4, 0, 0, 0, 0], [.25, .25, .25, .25, 0, 0], [.3, .2, .2, .15, .15, 0],
              [0, 0, .5, .2, .3, 0], [1 / 6] * 6]
    counts = np.array([rng.multinomial(600, np.asarray(s) @ p / (np.asarray(s) @ p).sum()) for s in shares], np.float32)
    best, share, size = langid.infer(counts, p)
    assert size.tolist() == [1, 2, 4, 5, 3, 6]
    for i, row in enumerate(counts):
        b, s, k = plain_set({t: float(row[t]) for t in np.flatnonzero(row)}, p.astype(float))
        assert (best[i], size[i]) == (b, k) and share[i] == pytest.approx(s, abs=1e-3)


def test_langid_odd_rows(odd, none, docs):
    rows = langid.report(odd).collect()
    assert len(rows) == odd.count()
    und = sorted(str(r.doc_id) for r in rows if r.lang_pred == "und")
    assert und == sorted(["3", "4", "5", "None", "9"]) and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.report(none).collect() == []
    unlabelled = langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    kept = langid.accept(odd, langid.train(docs))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


def test_quality_held_out(spark):
    df, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.report(df, labels).collect()
    held = sorted((r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label)
    good = sum(y for _, y in held)
    rank = sum(i + 1 for i, (_, y) in enumerate(held) if y)
    auc = (rank - good * (good + 1) / 2) / (good * (len(held) - good))
    assert auc > 0.95 and len(rows) == 1000
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_factorisation_identity():
    fm = quality.FactorisationMachine()
    rng = np.random.default_rng(0)
    fm.w = rng.normal(size=fm.w.shape)
    fm.v = rng.normal(size=fm.v.shape)
    col, x = np.array([1, 5, 9, 20]), rng.normal(size=4)
    raw, _ = fm._raw(np.zeros(4, int), col, x, 1)
    pair = sum(fm.v[col[i]] @ fm.v[col[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert raw[0] == pytest.approx(fm.b + fm.w[col] @ x + pair)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (None, 1, 0, "x"), (7, None, 0, "x"), (3, 0, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    rows = quality.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.report(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.report(none, labels).collect() == []


def test_pipeline_language_stage_without_labels_keeps_texts(spark, odd):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, bare, "")
    assert kept.columns == odd.columns
    letters = [r.doc_id for r in odd.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i in letters)


def test_pipeline_language_stage_rejects_by_likelihood(spark):
    """Noise goes, clean documents stay: labelled or not, short, mixed."""
    df = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    rnd = random.Random(3)
    noise = [(-i, " ".join("".join(rnd.choices("bcdfghjklmnpqrstvwxzQXZ", k=9)) for _ in range(200)), None) for i in range(1, 21)]
    rows = df.collect()
    clean = [(r.doc_id, r.text, r.lang if crc(r.doc_id) % 4 else None) for r in rows]
    short = [(10 ** 9 + r.doc_id, " ".join(r.text.split()[:8]), None) for r in rows[:100]]
    mixed = [(2 * 10 ** 9 + a.doc_id, a.text + " " + b.text, None) for a, b in zip(rows[:60], rows[60:120], strict=True)]
    both = spark.createDataFrame([*clean, *noise, *short, *mixed], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, "").collect()}
    assert kept == {r[0] for r in [*clean, *short, *mixed]}


def test_html_extracts_articles(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    rows = {r.page_id: r for r in html_blocks.report(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def test_html_blocks_and_labels(spark):
    model = html_blocks.train(spark.read.parquet(f"{SF01}/pages.parquet"))
    page = ('<html><body><header><a href=/>Home</a></header><div class="cookie-notice">We use cookies</div><div class="content">'
            "<h1>Title here</h1><p>First para of the story &amp; more.<p>Second  para\n that is <b>long</b> enough to count."
            '<div class="ad">Buy now</div><p>Third one ends it.</p></div><div class="comments"><p>Nice post from a reader that is '
            "long enough.</p></div><script>var x='<p>no</p>';</script><!-- <p>no</p> --><footer>&copy; x</footer></body></html>")
    seq = html_blocks.blocks(page)
    assert "no" not in [b[1] for b in seq] and "Second para that is long enough to count." in [b[1] for b in seq]
    kept = [b[1] for b, ok in zip(seq, model.label([seq])[0], strict=True) if ok]
    assert kept == ["Title here", "First para of the story & more.", "Second para that is long enough to count.", "Third one ends it."]


def test_html_elements_without_end_tag_hide_no_text():
    texts = lambda page: [b[1] for b in html_blocks.blocks(page)]
    assert texts("<html><head><title>T</title><meta charset=x><script>a<b</script><body><p>One<p>Two") == ["One", "Two"]
    assert texts("<head><title>T</title><link rel=x><p>One</p>") == ["One"]
    assert texts("<head><title>T</title></head><body><p>One</p>") == ["One"]
    assert texts("<header>H</header><p>One</p>") == ["H", "One"]
    assert texts('<p>One</p><svg class="i"/><p>Two</p><svg><text>no</text></svg><p>Three</p>') == ["One", "Two", "Three"]
    assert texts("<div><svg><path d='x'></div><p>One</p><svg><g><svg></svg></g></svg><p>Two</p>") == ["One", "Two"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg><p>One</p>") == ["One"]
    assert texts("<select-x><p>One</p></select-x><template-y>Two</template-y>") == ["One", "Two"]
    assert texts("<p>One</p><select><option>no</option></select><p>Two</p>") == ["One", "Two"]
    assert texts("<form><select><option>no</form><p>One</p><select><option>no</select><p>Two</p>") == ["One", "Two"]
    for tag in ("noscript", "template", "iframe", "textarea", "svg", "select"):
        assert texts(f"<p>One</p><{tag} id=x><p>Two</p>") == ["One", "Two"]
        assert texts(f"<p>One</p><{tag} id=x>no</{tag}><p>Two</p>") == ["One", "Two"]
    assert texts("<p>One</p><script>var a = 1; <p>no</p>") == ["One"]


def test_html_pages_without_semantic_tags(spark):
    """A table of div-only pages: the model learns from seeded pages and keeps the texts."""
    rnd = random.Random(4)
    stock = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ten", "sur") for b in ("ra", "vel", "do", "nis") for c in ("", "ton", "es", "ia")]
    sentence = lambda n: " ".join(rnd.choices(stock, k=n)).capitalize() + "."
    rows, want = [], []
    for i in range(60):
        body = [" ".join(sentence(rnd.randrange(6, 14)) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 8))]
        menu = "".join(f"<li><a href=/{k}>{rnd.choice(stock)}</a></li>" for k in range(4))
        wrap = ("content", "post", "entry", "story")[i % 4]
        rows.append((i, "u", f'<html><body><div class="menu"><ul>{menu}</ul></div><div class="{wrap}">'
                     + "".join(f"<p>{t}</p>" for t in body)
                     + f'</div><div class="sidebar"><p>{sentence(4)}</p></div><div class="footer">Imprint {rnd.choice(stock)}</div></body></html>'))
        want.append(" ".join(body))
    found = {r.page_id: r.text for r in html_blocks.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(found[i] == w for i, w in enumerate(want)) >= 54


def test_html_gradients():
    net = html_blocks.BlockLabeller()
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=(n, html_blocks.INPUT)).astype(np.float32) for n in (4, 2)]
    x, mask = html_blocks.pad(xs)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y = rng.integers(0, 2, mask.shape)

    def loss():
        p = net.probabilities(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    for name in ("wxf", "whb", "bf", "out"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        down = loss()
        net.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_html_odd_rows(spark):
    long = "<article>" + "<p>some words of text here.</p>" * 5000 + "</article>"
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<article><p>One &lt;two&gt;", "x"), (None, "u", "</p></div>plain < text", "x"),
         (4, "u", long, "x"), (4, "u", long, "x")], "page_id long, url string, html string, text string")
    rows = html_blocks.report(pages).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 6 and by[1].text == by[2].text == "" and by[1].n_chars == 0
    assert by[3].text == "One <two>"
    assert html_blocks.report(pages.limit(0)).collect() == []


def test_leaks_found_and_clean_texts_left(spark):
    df, bench = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    rows = decontaminate.report(df, bench).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        item = set(re.findall(r"\w+", items[r.item_id].lower()))
        assert len(item & set(re.findall(r"\w+", texts[r.doc_id].lower()))) >= 0.7 * len(item)
    kept = decontaminate.Retrieval(df, bench).clean(df)
    assert {r.doc_id for r in kept.collect()} == texts.keys() - {r.doc_id for r in rows}


def test_leaks_paraphrased(spark, docs):
    """Items with a sixth of their words replaced and other case and punctuation are still found."""
    rnd = random.Random(6)
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    filler = " ".join(docs.first().text.split()[:120])
    rows = []
    for r in bench[:20]:
        w = [x.strip(".,").upper() for x in r.text.split()]
        for k in rnd.sample(range(len(w)), len(w) // 6):
            w[k] = "replaced"
        rows.append((r.item_id, filler + " " + " ".join(w) + " " + filler))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = df.unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.report(whole, spark.createDataFrame(bench)).collect() if r.doc_id < 10_000}
    assert len({(i, i) for i, _ in rows} & found) >= 18


def test_leaks_odd_rows(spark, odd, none, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "of the"), (4, "alpha beta gamma delta epsilon zeta eta theta"),
                                   (4, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    both = odd.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = decontaminate.report(both, bench).collect()
    assert {str(r.doc_id) for r in rows} == {"1", "2", "None"} and {r.item_id for r in rows} == {4}
    assert decontaminate.report(odd, bench.limit(0)).collect() == []
    assert decontaminate.report(none, bench).collect() == []
    kept = decontaminate.Retrieval(odd, bench).clean(odd)
    assert kept.columns == odd.columns


def check_packing(df, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            want[r.doc_id].append((k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(r.length for r in rows) // 2048)


def test_leaks_of_short_items_and_other_scripts(spark, docs):
    items = [(1, "\u4eba\u5de5\u667a\u80fd\u7684\u5386\u53f2\u53ef\u4ee5\u8ffd\u6eaf\u5230\u54ea\u4e00\u5e74\uff1f"),
             (2, "\u0e1b\u0e23\u0e30\u0e40\u0e17\u0e28\u0e44\u0e17\u0e22"), (3, "Quokka zeppelin xylem"), (4, "\u65e5\u672c"),
             (5, "Какой город был столицей империи до начала войны"), (6, "straße über größe"), (7, "?!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    said = {1: "\u6211\u4eec\u95ee\u4e86" + items[0][1] + "\u7b54\u6848\u662f\u8fd9\u4e2a", 2: "\u0e04\u0e37\u0e2d" + items[1][1] + "\u0e04\u0e23\u0e31\u0e1a",
            3: "a (quokka ZEPPELIN, xylem) b", 4: "\u6771\u4eac\u306f\u65e5\u672c\u3067\u3059", 5: "вот: «" + items[4][1].upper() + "» да", 6: "die STRASSE “ÜBER” GRÖSSE, ja"}
    near = [(101, "quokka zeppelin and xylem"), (102, "\u672c\u65e5"), (103, "quokka zeppelin"), (104, "xylem ?! b")]
    plain = [(1000 + r.doc_id, r.text) for r in docs.limit(50).collect()]
    df = spark.createDataFrame([*said.items(), *near, *plain], "doc_id long, text string").repartition(2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.report(df, bench).collect()} == {(i, i) for i in said}
    assert {r.doc_id for r in decontaminate.Retrieval(df, bench).clean(df).collect()} == {i for i, _ in [*near, *plain]}


def test_packing(docs):
    bins, bound = check_packing(docs, packing.pack(docs, tokenizer_path()).collect())
    assert bins <= 1.02 * bound + 1


def test_packing_word_ids_on_random_texts():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    rnd = random.Random(3)
    bits = ["a", "B", "é", "É", "é", "'s", "'", "'T", "don't", " ", "\n", "\t", ".", ",", "...", "!", "<|endoftext|>", "<", "|>",
            "日本", "İ", "ß", "ΟΣ", "1", "23", "%%%", "x.y", "#", "—", "“", "ﬁ", "̸", "=", "🙂", "\x1c", "\x85"]
    for _ in range(3000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        want = np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids.encode([s.encode()])[0] == want


def test_packing_plan_places_everything():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(k) for n, k in zip(rng.integers(1, 2049, 300), rng.integers(1, 90, 300), strict=True)}
    patterns = packing.plan(histogram)
    placed = defaultdict(int)
    for times, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            placed[n] += times * k
    assert placed == histogram
    table = packing.slots(patterns)
    assert all((np.diff(t[:, 0]) > 0).all() and t[0, 0] == 0 for t in table.values())


def test_packing_odd_rows(odd, none):
    check_packing(odd, packing.pack(odd, tokenizer_path()).collect())
    assert packing.pack(none, tokenizer_path()).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    from hemicycle.llm.common import stored
    from tests.llm import brute

    df = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    out, docs = {}, df
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF001), name)
        out[name] = docs
    for name in list(out)[:-1]:
        assert out[name].columns == df.columns
    assert out["language"].count() == df.count()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for r in df.collect():
        best[key(r.text)] = min(best.get(key(r.text), (0, 0)), (-len(r.text), r.doc_id)) if key(r.text) in best else (-len(r.text), r.doc_id)
    kept = sorted(out["exact_dedup"].collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in kept} == {i for _, i in best.values()}
    root = brute.components([brute.shingle_set(r.text, 5) for r in kept])
    near = [r for i, r in enumerate(kept) if root[i] == i]
    assert {r.doc_id for r in out["near_dedup"].collect()} == {r.doc_id for r in near}
    clean = {r.doc_id for r in near if not any(b in r.text for b in bench)}
    left = {r.doc_id for r in out["decontaminate"].collect()}
    assert left <= clean and len(clean - left) <= 2
    check_packing(out["decontaminate"], out["packing"].collect())


def test_pipeline_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    for i, df in enumerate((odd, none)):
        d = str(tmp_path / str(i))
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, d).collect()
        assert {str(r.doc_id) for r in rows} == ({"1", "6", "7", "10"} if i == 0 else set())


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!x ", "<a' \"", "<aa", "<title>", "<div>x", "</x>", "<p><span>x", "<svg><g>"])
@pytest.mark.parametrize("end", ["", '">'])
def test_broken_pages_take_time_in_proportion(unit, end):
    """A quarter of a megabyte of tags without end; a quadratic reader would take minutes."""
    page = unit * ((1 << 18) // len(unit)) + end
    began = time.process_time()
    html_blocks.blocks(page)
    assert time.process_time() - began < 4


def test_tags_without_end_are_text():
    assert [b[1] for b in html_blocks.blocks('<p>one</p><a "<p>two</p>')] == ["one", '<a "', "two"]
    assert [b[1] for b in html_blocks.blocks("<p>one</p><p>5 < 6 <b")] == ["one", "5 < 6 <b"]
    deep = html_blocks.blocks("<article>" + "<div>" * 300 + "deep")
    assert len(deep) == 1 and len(deep[0][0]) == html_blocks.DEPTH

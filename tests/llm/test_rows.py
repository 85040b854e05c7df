"""Hard negatives, fill-in-the-middle and chat formatting against plain versions in Python."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hemicycle.llm import chat_format, fill_middle, hard_negatives

# ---------------------------------------------------------------- hard negatives


def mined(rows, anchor_every=3, positives=5, negatives=3):
    """Brute force over (id, label, vector) rows."""
    width = max((len(v) for _, _, v in rows), default=1)
    padded = [np.array([int(np.floor(256 * float(x))) for x in v] + [0] * (width - len(v)), object) for _, _, v in rows]
    out = set()
    for (a, label, _), q in zip(rows, padded):
        if a % anchor_every:
            continue
        score = [int(sum(q * p)) for p in padded]
        same = sorted((-s, i) for s, (i, g, _) in zip(score, rows) if g == label and i != a)[:positives]
        for neg, p in same:
            ps = -neg
            fits = sorted((-s, i) for s, (i, g, _) in zip(score, rows) if g != label and 50 * ps <= 100 * s <= 95 * ps)
            out |= {(a, p, k + 1, i, ps, -s) for k, (s, i) in enumerate(fits[:negatives])}
    return out


def found(spark, rows, schema="vec_id long, embedding array<float>, label int", **more):
    df = spark.createDataFrame([(i, v, g) for i, g, v in rows], schema).repartition(3)
    index = hard_negatives.Index(hard_negatives.prepared(df))
    return index, [tuple(r) for r in hard_negatives.mine(index, F.col("vec_id") % 3 == 0, **more).collect()]


def clustered(n, dims, seed, spread=0.2, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    at = rng.integers(0, centres, n)
    v = (middle[at] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, int(rng.integers(0, 4)), [float(x) for x in row]) for i, row in enumerate(v)]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    rows = clustered(300, 5, 3)
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(90)]  # one vector many times: ties by id
    _, got = found(spark, rows)
    assert len(got) == len(set(got))
    assert set(got) == mined(rows)


def test_hard_negatives_odd_rows(spark):
    good = [(3, 1, [1.0, 0.5]), (4, 1, [0.9, 0.4]), (5, 2, [0.8, 0.2]), (6, 2, [0.5]), (7, 2, []), (9, 0, [-1.0, 2.0])]
    bad = [(12, None, [1.0, 1.0]), (15, 1, None), (18, 1, [1.0, None]), (21, 1, [float("nan"), 0.0]),
           (24, 1, [float("inf"), 0.0]), (None, 1, [1.0, 1.0]), (27, 1, [1e9, 0.0])]
    again = [good[0], (4, 3, [9.0, 9.0])]  # a repeated row, and an id with two rows: the smaller label takes part
    df = spark.createDataFrame([(i, v, g, "x", 1.5) for i, g, v in good + bad + again],
                               "vec_id long, embedding array<float>, label int, v string, score double")
    index = hard_negatives.Index(hard_negatives.prepared(df))
    assert {tuple(r) for r in hard_negatives.mine(index, F.col("vec_id") % 3 == 0).collect()} == mined(good)
    empty = hard_negatives.Index(hard_negatives.prepared(df.limit(0)))
    out = hard_negatives.mine(empty, F.col("vec_id") % 3 == 0)
    assert out.collect() == [] and out.columns == [c.split()[0] for c in hard_negatives.RESULT.split(", ")]


def test_hard_negatives_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-200_000, 200_000, 6)]) for i in range(60)]
    index, got = found(spark, rows, "vec_id long, embedding array<double>, label int")
    assert index.kind is np.int64
    assert set(got) == mined(rows)


def test_hard_negatives_queue_prunes():
    """On separated groups most leaves are never read; what is found equals reading them all."""
    rows = clustered(2048, 4, 7, spread=0.02, centres=16)
    vecs = np.floor(256 * np.array([v for _, _, v in rows], np.float32).astype(float))
    keys = [vecs[:, i] for i in range(4)]
    leaves = hard_negatives._leaves(np.arange(2048), keys, 0)
    assert sorted(np.concatenate(leaves)) == list(range(2048)) and max(map(len, leaves)) <= hard_negatives.LEAF
    order = np.concatenate(leaves)
    at = np.concatenate([[0], np.cumsum([len(x) for x in leaves])[:-1]])
    v, ids = vecs[order].astype(np.int32), order.astype(np.int64)
    labels = np.zeros(2048, np.int64)
    ends = np.stack([np.zeros(len(at)), np.zeros(len(at)), at]).astype(np.int64)
    tile = {"ids": ids.tobytes(), "labels": labels.tobytes(), "vecs": v.tobytes(),
            "leaf_lo": np.minimum.reduceat(v, at).tobytes(), "leaf_hi": np.maximum.reduceat(v, at).tobytes(),
            "leaf_label": ends.tobytes()}
    tree = hard_negatives._Tree([tile], 4, np.float64)
    read = 0
    for a in range(0, 2048, 64):
        score = vecs @ vecs[a]
        for windows in ([(-np.inf, np.inf)], [(score.max() * 0.5, score.max() * 0.6)]):
            want = hard_negatives._Wanted(a, 0, True, windows, 5)
            taken = []
            take = want.take
            want.take = lambda s, i, g: (taken.append(len(s)), take(s, i, g))
            hard_negatives._search(tree, vecs[a], want)
            read += sum(taken)
            fits = [i for i in range(2048) if i != a and windows[0][0] <= score[i] <= windows[0][1]]
            assert list(want.found[0][1]) == sorted(fits, key=lambda i: (-score[i], i))[:5]
    assert read < 0.5 * 64 * 2048


# ---------------------------------------------------------------- fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim(doc_id, text):
    text = text or ""
    tok = TOKEN.findall(text)
    n = len(tok)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text)]
    return (doc_id, n, form, *sizes, *sha)


def test_fill_middle_odd_rows(odd, none):
    want = sorted((fim(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert sorted(map(tuple, fill_middle.report(odd).collect()), key=str) == want
    assert fill_middle.report(none).collect() == []


def test_fill_middle_texts(spark, docs):
    texts = [" a  b\n", "\t\n ", "x", "é\U0001F600 ü\x0b z\x0c\x1c\x85  q", "a <P> b", "<S>", "c<M", "> $1 \\ {2}", "<<S", "<P<S",
             "one $2 two \\E three", "\x00 nul \x00", " lead", "trail \r\n\t "]
    rows = [(17 * i + j, t) for i, t in enumerate(texts) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in fill_middle.report(df).collect()} == {fim(*r) for r in rows}
    sample = docs.select("doc_id", "text").collect()
    assert {tuple(r) for r in fill_middle.report(docs).collect()} == {fim(*r) for r in sample}


def test_fill_middle_very_long_text(spark):
    text = "ab é\n" * 300_000 + "   "
    rows = [(i, text) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in fill_middle.report(df).collect()}
    assert got == {fim(*r) for r in rows} and {r[2] for r in got} != {"plain"}


def test_fill_middle_has_no_python_or_shuffle(docs):
    plan = fill_middle.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- chats


def chats(rows):
    """Brute force over (conv, turn, role, text) in order: report and full examples."""
    out, examples = {}, {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = [t for role, t in turns if role == "assistant"]
        parts = [f"<|im_start|>{chat_format.role_written(r)}\n{chat_format.escape(t)}<|im_end|>\n" for r, t in turns]
        full = ["".join(parts[:i + 1]) for i, (r, _) in enumerate(turns) if r == "assistant"]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), "".join(loss))]
        out[conv] = (conv, len(turns), sha[0], len("".join(loss)), sha[1], sum(map(len, full)), len(full))
        examples[conv] = [(x, t) for x, t in zip(full, loss)]
    return out, examples


SCHEMA = "conv_id long, turn long, role string, text string, part string, example string, chars long"
ROWS = [(1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|> <\\|x"), (1, 2, "assistant", "yes <|"), (1, 3, "user", None),
        (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "assistant", "first"), (3, None, "user", "no reply"),
        (4, 0, "we<|im_start|>ird\n%0A", "x"), (4, 1, None, "y"), (4, 1, "assistant", "same turn"),
        (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (6, 0, "user", "twice"), (6, 0, "user", "twice"),
        (7, 0, "user", "long " * 50_000), (7, 1, "assistant", "é\U0001F600 " * 40_000), (7, 2, "assistant", "end")]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))


def test_chats_read_back(spark, monkeypatch):
    rows = ROWS + [(8, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(150)]
    df = spark.createDataFrame([(*r, "x", "y", 9) for r in rows], SCHEMA).repartition(5)
    want, examples = chats(ordered(rows))
    assert {r[0]: tuple(r) for r in chat_format.report(df).collect()} == want
    parts = chat_format.format_chats(df)
    assert parts.filter("conv_id = 8 and example is null").count() >= 150 // chat_format.PART_TURNS
    assert parts.agg(F.max("turns")).first()[0] <= chat_format.PART_TURNS
    got = {}
    for r in chat_format.expanded(parts).orderBy("conv_id", "part", "example").collect():
        got.setdefault(r.conv_id, []).append((r.text, chat_format.unescape(r.text[r.loss_start:r.loss_end])))
    assert got == {c: e for c, e in examples.items() if e}


def test_chats_size_is_linear(spark):
    def written(n):
        df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"),
                                   F.lit("some words here").alias("text"))
        return chat_format.format_chats(df).agg(F.sum(F.length("text"))).first()[0]
    assert written(4000) < 2.2 * written(2000)


def test_chats_report_reads_examples_in_full(spark, monkeypatch):
    """What the report stores holds every example with all turns before it, also where a conversation has many parts and slices."""
    rows = [(8, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(150)]
    rows += [(None, i, "assistant" if i % 3 else "user", f"lost {i}") for i in range(90)]
    rows += [(k, i, "assistant" if i else "user", "short") for k in range(20, 60) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want, examples = chats(ordered(rows))
    kept, real = {}, chat_format.stored

    def stored(df, name, *more, **named):
        kept[name] = real(df, name, *more, **named)
        return kept[name]

    monkeypatch.setattr(chat_format, "stored", stored)
    for size in (64, 2, 1):
        monkeypatch.setattr(chat_format, "SLICE", size, raising=False)
        assert {r[0]: tuple(r) for r in chat_format.report(df).collect()} == want
        got = {}
        for name in kept:
            if "loss_start" in kept[name].columns:
                for r in kept[name].filter("example is not null").select("conv_id", "text").collect():
                    got.setdefault(r.conv_id, set()).add(r.text)
        assert {c: {x for x, _ in e} - got.get(c, set()) for c, e in examples.items()} == {c: set() for c in examples}


def test_chats_empty_and_control(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.report(none).collect() == []
    (only,) = chat_format.report(chat_format.with_control(none)).collect()
    assert tuple(only) == chats([(-1, 0, "user", chat_format.CONTROL), (-1, 1, "assistant", chat_format.CONTROL)])[0][-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>im_startend\n %0A3C25é", max_size=60))
def test_chat_escapes(text):
    written = chat_format.escape(text)
    assert "<|" not in written and chat_format.unescape(written) == text
    assert chat_format.role_read(chat_format.role_written(text)) == text
    turn = f"{chat_format.START}{chat_format.role_written(text)}\n{written}{chat_format.END}"
    assert list(chat_format.turns_of(turn * 2)) == [(text, text)] * 2

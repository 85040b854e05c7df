"""Personal data: overlapping candidates scored by boosted trees, beside the fixed base patterns.

High-recall generators propose overlapping spans of the kinds ``email``, ``ip``,
``card`` and ``phone`` (obfuscated addresses, numbers with any separators).
Gradient-boosted trees score each from format features (digits, separators,
group shapes, checksum, octets) and context features (neighbouring characters,
cue words). Scores are Platt-calibrated on held-out rows and a threshold per kind keeps
added spans precise; of overlapping additions the best score wins. Spans of
the base patterns always stay; an addition may not overlap one.

Training rows are labelled samples: of about ``SAMPLE_DOCS`` documents chosen by a hash of
their id, at most ``SAMPLE_ROWS`` candidates, labelled by the base patterns, and seeded examples of further formats and of look-alikes (dates,
versions, prices, failing checksums). The scan reads every row and whole text.
Null and empty texts have no span; any table may be empty; extra columns are
not read; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.boosting import BoostedTrees
from hemicycle.llm.common import byte_view, text_batches

KINDS = ("email", "ip", "card", "phone")
#: fixed values of the base patterns. ``(?<![0-9])`` only spares useless starts inside a run of digits:
#: a start there fails just as the start of the run did.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 20_000
SEEDED_ROWS = 400
PRECISION, FLOOR = 0.995, 0.9
#: candidate generators of the kinds, in the order of KINDS
PROPOSE = (
    re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
               r"(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,8}"),
    re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])"),
)
CUES = (("mail", "contact", "write"), ("ip", "host", "server", "address"),
        ("card", "visa", "credit", "carte", "tarjeta", "karte"), ("phone", "tel", "call", "mobile", "fax", "cell"),
        ("version", "release", "v.", "chapter"), ("isbn", "order", "invoice", "serial", "sku", "id", "no."),
        ("$", "€", "usd", "eur", "price", "total"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:  # an address starts where the run of local characters before its @ does
        m = DOMAIN.match(text, at)
        if m:
            lo = at
            while lo > end and LOCAL.match(text, lo - 1):
                lo -= 1
            if lo < at:
                out.append((0, lo, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    return [(k, *m.span()) for k, p in enumerate(PROPOSE) for m in p.finditer(text)]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context features of one candidate."""
    s = text[start:end]
    d = _digits(s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    before, after = text[max(0, start - 24):start].lower(), text[end:end + 12].lower()
    octets = [int(g) for g in re.split(r"[^0-9]+", s)[:4] if g] if kind == 1 else []
    last = text[start - 1] if start else " "
    nxt = text[end] if end < len(text) else " "
    near = lambda cues: float(any(c in before for c in cues))
    return [float(kind == k) for k in range(4)] + [
        float(len(s)), float(len(d)), float(len(groups)), float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0), float(max(groups, default=0)), float(min(groups, default=0)),
        float(s.count("-")), float(s.count(".")), float(s.count(" ")), float(s.count("(")), float(s.count("/")),
        float(s.startswith("+")), float(s.startswith("(")), float(luhn(d)) if d else 0.0, float(len(set(d))),
        float(d[:1] or 0), float(bool(octets) and max(octets) <= 255), float("@" in s),
        float(" at " in s), float("(" in s and "at" in s or "[" in s), float(groups == [3, 3, 4]),
        float(len(groups) == 3 and groups[-1] == 4 and groups[0] <= 2 and groups[1] <= 2),
        float(groups in ([4, 4, 4, 4], [4, 6, 5])), float(last.isalnum()), float(nxt.isalnum()),
        float(last in ".,$€#%/-_"), float(nxt in "%$€/_-"),
        *[near(c) for c in CUES], float(bool(re.match(r"\s*(?:ext|x[0-9])", after)))]


def seeded_examples() -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label): further formats and look-alikes, the same on every run."""
    rng = np.random.Generator(np.random.PCG64(3))
    num = lambda n: "".join(rng.choice(list("0123456789"), n))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(3, 9))))

    def card(ok: bool) -> str:
        d = "4" + num(14)
        good = next(c for c in "0123456789" if luhn(d + c))
        return d + (good if ok else str((int(good) + int(rng.integers(1, 10))) % 10))

    split = lambda s, sep: sep.join(s[i:i + 4] for i in range(0, 16, 4))
    makers = [
        (0, 1, lambda: f"{word()}.{word()} (at) {word()} (dot) com"), (0, 1, lambda: f"{word()}[at]{word()}[dot]org"),
        (0, 1, lambda: f"{word()}{num(2)} at {word()} dot com"), (0, 0, lambda: f"{word()} at {word()}.{word()}"),
        (0, 0, lambda: f"{word()} at {word()}. {word()}"), (0, 0, lambda: f"{word()} @ {word()}. {word()}"),
        (1, 0, lambda: ".".join(str(rng.integers(256, 1000)) for _ in range(4))),
        (1, 0, lambda: ". ".join(str(rng.integers(0, 256)) for _ in range(4))),
        (2, 1, lambda: split(card(True), "-")), (2, 1, lambda: split(card(True), ".")),
        (2, 1, lambda: split(card(True), "/")), (2, 0, lambda: split(card(False), "-")),
        (2, 0, lambda: split(card(False), ".")), (2, 0, lambda: card(False)), (2, 0, lambda: num(18)),
        (2, 0, lambda: " ".join(num(1) for _ in range(14))),
        (3, 1, lambda: f"({num(3)}) 555-{num(4)}"), (3, 1, lambda: f"{rng.integers(200, 999)}-555-{num(4)}"),
        (3, 1, lambda: f"{rng.integers(200, 999)}.{rng.integers(200, 999)}.{num(4)}"),
        (3, 0, lambda: f"{rng.integers(1, 29):02d}/{rng.integers(1, 13):02d}/20{num(2)}"),
        (3, 0, lambda: f"20{num(2)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"),
        (3, 0, lambda: num(int(rng.integers(7, 15)))), (3, 0, lambda: f"{num(3)}.{num(3)}.{num(3)}"),
        (3, 0, lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"), (3, 0, lambda: f"{num(3)} {num(3)} {num(3)}"),
        (3, 0, lambda: " ".join(num(2) for _ in range(5))), (3, 0, lambda: f"20{num(2)}-20{num(2)}")]
    lead = {0: ("contact ", "mail: "), 1: ("host ",), 2: ("card ", "visa: "), 3: ("call ", "tel: ", "phone ")}
    bad = ("version ", "order no. ", "total $", "isbn ", "")
    out = []
    for kind, label, make in makers:
        for i in range(SEEDED_ROWS):
            s = make()
            cue = lead[kind][i % len(lead[kind])] if label and i % 2 else "" if label else bad[i % len(bad)]
            text = f"{word()} {word()} {cue}{s} {word()}."
            at = text.index(s)
            out.append((text, kind, at, at + len(s), label))
    return out


def _rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that may hold a base span or a proposal: an ``@`` or ``at`` with a dot, or seven digits."""
    at = np.zeros(len(off) - 1, bool)
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    at |= digit[off[1:]] - digit[off[:-1]] >= 4
    hits = np.flatnonzero(data == 64)
    at[np.searchsorted(off, hits, side="right") - 1] = True
    raw = data.tobytes().lower()
    for needle in (b"(dot)", b"[dot]", b" dot ", b"(at)", b"[at]"):
        i = raw.find(needle)
        while i >= 0:
            row = int(np.searchsorted(off, i, side="right")) - 1
            at[row] = True
            i = raw.find(needle, int(off[row + 1]))
    return np.flatnonzero(at)


def _texts(batches: Iterator[pa.RecordBatch]):
    """(batch, [(row, text)]) with only the rows that may hold something."""
    for batch in batches:
        found = []
        for lo, hi in text_batches(batch, "text"):
            data, off = byte_view(batch.column("text"), lo, hi)
            found += [(lo + int(r), data[off[r]:off[r + 1]].tobytes().decode("utf-8", "replace"))
                      for r in _rows(data, off)]
        yield batch, found


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, found in _texts(batches):
        ids, pos, xs, ys = [], [], [], []
        for row, text in found:
            base = base_spans(text)
            for k, s, e in proposals(text):
                same = any(b[0] == k and b[1] <= s and e <= b[2] or b == (k, s, e) for b in base)
                if same or not any(b[1] < e and s < b[2] for b in base):
                    ids.append(str(batch.column("doc_id")[row].as_py()))
                    pos.append(s)
                    xs.append(features(text, k, s, e))
                    ys.append(int(same))
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(pos, pa.int64()),
                               pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())],
                              names=["id", "pos", "x", "y"])


def train(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[BoostedTrees, np.ndarray]:
    """Boosted trees and a threshold per kind; ``df`` has doc_id and text."""
    share = min(1.0, SAMPLE_DOCS / max(df.count(), 1))
    chosen = df.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = (chosen.mapInArrow(_sample, "id string, pos long, x array<double>, y int")
            .orderBy(F.xxhash64("id", "pos"), "id", "pos").limit(sample_rows).collect())
    seeded = seeded_examples()
    x = np.array([r.x for r in rows] + [features(t, k, s, e) for t, k, s, e, _ in seeded])
    y = np.array([r.y for r in rows] + [v for *_, v in seeded], float)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(y))
    x, y = x[order], y[order]
    model = BoostedTrees().fit(x, y)
    held = np.arange(len(y)) % 4 == 3
    p = model.predict(x[held])
    cut = [model.threshold(p[of], y[held][of], PRECISION, FLOOR) for of in (x[held][:, k] > 0 for k in range(4))]
    return model, np.array(cut)


def find(text: str, model: tuple[BoostedTrees, np.ndarray]) -> list[tuple[int, int, int, float, bool]]:
    """(kind, start, end, score, base) of one text, by kind, then start."""
    base = base_spans(text)
    out = [(k, s, e, 1.0, True) for k, s, e in base]
    free = [c for c in proposals(text) if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
    if free:
        p = model[0].predict(np.array([features(text, *c) for c in free]))
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i])):
            k, s, e = free[i]
            if p[i] >= model[1][k] and not any(a < e and s < b for a, b in taken):
                taken.append((s, e))
                out.append((k, s, e, float(p[i]), False))
    return sorted(out)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                            ("score", pa.float64()), ("base", pa.bool_())]))


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _texts(batches):
            rows: list[list] = [[] for _ in range(len(batch))]
            for row, text in found:
                rows[row] = [{"kind": KINDS[k], "start": s, "end": e, "score": p, "base": b}
                             for k, s, e, p, b in find(text, model)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, SPANS)], names=["doc_id", "spans"])
    return run


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score, base>>) for every row; positions in code points."""
    kind = dict(df.dtypes)[doc_id]
    narrow = df.selectExpr(f"`{doc_id}` as doc_id", f"coalesce(`{text}`, '') as text")
    model = train(narrow, sample_rows)
    return narrow.mapInArrow(_scan(model), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,"
                                           "score:double,base:boolean>>")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[REDACTED]") -> str:
    """``text`` with the spans (start, end) replaced; overlapping spans merge."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def report(df: DataFrame) -> DataFrame:
    """Digest per document: counts and hash of the base spans, all spans as text."""
    n = "cast(size(filter(spans, s -> s.base and s.kind = '{0}')) as bigint) as n_{0}"
    line = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    return scan(df).selectExpr("doc_id", *[n.format(k) for k in KINDS],
                               "sha2(" + line.format("filter(spans, s -> s.base)") + ", 256) as base_sha256",
                               line.format("spans") + " as spans")


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def base_digest(text: str) -> str:
    """The base digest of a brute-force scan, for tests."""
    return hashlib.sha256(digest(base_spans(text)).encode()).hexdigest()

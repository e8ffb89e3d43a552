"""Fill-in-middle, chat formatting and whitening against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from strata.llm import chat, fill_middle, whitening
from strata.llm.base import ready
from strata.llm.queries import QUERIES
from strata.session import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _ready(spark):
    ready(spark)


# fill in the middle


def units_brute(text, unit):
    """Places where the units of a text start, the first taken as 0."""
    if unit == "char":
        return list(range(len(text)))
    if unit == "line":
        return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
    blank = " \t\n\v\f\r"
    return [i for i in range(len(text)) if text[i] not in blank and (i == 0 or text[i - 1] in blank)]


def fill_brute(doc_id, text, unit="char", plain_from=90, spm_below=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    starts = units_brute(text, unit)
    n = len(starts)
    a, b = ((0 if k == 0 else len(text) if k == n else starts[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return (doc_id, n, "plain", None, None, text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return (doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(spark, unit):
    rng = random.Random(4)
    signs = "ab \n\té中\U0001f600<S>PM"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "a b c d"), (1, None), (2, ""), (3, "   "), (4, "\n"), (5, "x<P>y"), (6, "<S"), (7, "<<S>"), rows[0], rows[0]]
    rows += [(500, "中" * 300_000 + "\n" + "b " * 700_000), (501, "<" * 1000 + ">" * 1000)]
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "doc_id long, text string, form string, n int, output string")
    made = fill_middle.fill_in_middle(df.repartition(3), unit)
    got = made.withColumn("back", fill_middle.restored(made.form, made.output)).collect()
    want = [(*fill_brute(*r, unit), r[1] or "") for r in rows]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.where("false"), unit).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 8, 1000).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(symbols)
    places = np.arange(1001)
    for s in range(8):
        assert (matrix.rank(s, places) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
    hit = np.flatnonzero(np.isin(symbols, (2, 5)))
    found = matrix.locate((2, 5), np.arange(len(hit)), np.zeros(len(hit), np.int64), np.full(len(hit), 1000))
    assert (found == hit).all()
    assert fill_middle.WaveletMatrix(symbols[:0]).rank(3, np.zeros(2, np.int64)).tolist() == [0, 0]


def test_fill_query_reads_every_document(spark):
    got = QUERIES["op13_wavelet_fill_in_middle"](spark, SF).collect()
    want = {r.doc_id: fill_brute(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(want)
    for r in got:
        text = want[r.doc_id][-1]
        assert r.output_sha256 == hashlib.sha256(text.encode()).hexdigest()


# chats


def fold_brute(events):
    """Messages of one conversation, by the words of the docstring."""
    held = {}
    for kind, message, role, text in events:
        old = held.get(message, (None, ""))
        if kind in ("edit", "regenerate"):
            held = {m: v for m, v in held.items() if m < message}
            old = (old[0], "")
        said = old[1] + (text or "" if kind != "regenerate" else "")
        held[message] = (role if role is not None else old[0], said)
    return [held[m] for m in sorted(held)]


def digest_brute(conv, messages):
    turns = "".join(f"{r or ''}\n{t}\n" for r, t in messages)
    loss = "".join(t for r, t in messages if r == "assistant")
    return (conv, len(messages), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_logs_fold_across_partitions(spark, partitions):
    rng = random.Random(partitions)
    log, convs = [], {}
    for conv in [*range(12), None]:
        events = []
        for seq in range(600 if conv == 3 else rng.randrange(1, 40)):
            message = rng.randrange(0, 3 + seq // 6)
            kind = rng.choices(["open", "delta", "edit", "regenerate", "odd", None], [2, 6, 0.4, 0.4, 1, 1])[0]
            role = rng.choice([None, None, "user", "assistant", "a>b\\", ""])
            text = rng.choice([None, "", "x", "</turn>", "<turn user>\n", "\\", "\\<turn", "\n</turn>\n", "é\U0001f600", "y\n"])
            events.append((kind, message, role, text))
            log.append((conv, seq, message, kind, role, text, "part", True))
        convs[conv] = fold_brute(events)
    rng.shuffle(log)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string, part string, whole boolean")
        formatted = chat.format_log(df, Scratch(spark))
        got = chat.digests(formatted).collect()
        shown = formatted.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((digest_brute(c, m) for c, m in convs.items()), key=repr)
    for r in got:
        parts = [x for x in sorted(shown, key=lambda x: x.part) if x.conv_id == r.conv_id]
        text = "".join(p.text for p in parts)
        assert r.formatted_chars == len(text)
        assert [(a or "", b) for a, b in convs[r.conv_id]] == list(chat.parse(text))


def test_conversations_as_logs(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("user", f"q{c} 中"), ("assistant", "w " * (c * 50)), ("user", ""), ("assistant", None)])]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, None, "system", "first"), (None, 1, "assistant", "z"), (90, 1, None, None), (91, 0, "assistant", "long \\ </turn>" * 40_000)]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    got = {r.conv_id: tuple(r) for r in chat.digests(chat.format_log(chat.as_log(df.repartition(4)), Scratch(spark))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        if conv == 1:  # equal turns go by a hash, so only what does not depend on it
            assert got[1][1] == 6 and got[1][3] == 100
            continue
        assert got[conv][:5] == digest_brute(conv, [(r, t or "") for _, _, r, t in mine]), conv
    assert chat.digests(chat.format_log(chat.as_log(df.where("false")), Scratch(spark))).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        said = [("".join(rng.choice(["<turn", "</turn", ">", "\\", "\n", " ", "a", "<"]) for _ in range(rng.randrange(8)))) for _ in range(2)]
        text, spans = chat.render([(said[0], said[1]), ("assistant", said[0])])
        assert list(chat.parse(text)) == [(said[0], said[1]), ("assistant", said[0])]
        assert chat.unescape(text[spans[-1]["start"] : spans[-1]["end"]]) == said[0]


# whitening


def whitened_brute(rows, k=16):
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    x = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in usable]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, sums = len(fit), [sum(c) for c in fit.T]
    centred = (fit - np.array([s // n for s in sums], object)).astype(float) - np.array([s % n / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    out = {}
    for i, v in x:
        y = np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)])
        out.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), y @ vectors[:, order] / np.sqrt(values[order])))
    return n, values[order] / np.trace(cov), out


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(20, 20)) * 0.9 ** np.arange(20)
    rows = [(i, [float(c) for c in mix @ rng.normal(size=20)]) for i in range(500)]
    rows += [(i + 1000, rows[0][1]) for i in range(200)] + [(0, rows[0][1])]
    nan = float("nan")
    bad = [(2000, None), (2001, []), (2002, [None] + [1.0] * 19), (2003, [nan] * 20), (2004, [float("inf")] + [0.0] * 19), (2005, [1.0] * 3)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows + bad], "vec_id long, embedding array<double>, n int, whitened double")
    got = whitening.whiten(df.repartition(5), Scratch(spark)).collect()
    n, explained, want = whitened_brute(rows)
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        deviation, y = want[r.vec_id][0]
        assert r.deviation == deviation and abs(r.explained - explained[r.component - 1]) < 1e-9
        if abs(y[r.component - 1]) > 1e-3:
            flip = sign.setdefault(r.component, np.sign(r.whitened * y[r.component - 1]))
            assert abs(r.whitened * flip - y[r.component - 1]) < 1e-6
    assert len(sign) == 16


def test_whitening_edges(spark):
    def run(rows, schema="vec_id long, embedding array<double>"):
        return whitening.whiten(spark.createDataFrame(rows, schema), Scratch(spark)).orderBy("vec_id", "component").collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    one = run([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])])
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    line = run([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])
    assert [(r.component, r.whitened is None, r.explained) for r in line[:3]] == [(1, False, pytest.approx(1.0)), (2, True, 0.0), (3, True, 0.0)]
    huge = run([(1, [1e300, -1e300]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])
    assert len(huge) == 6 and huge[0].deviation is None and huge[0].identity_error < 1e-4
    small = run([(1, [1e6, 0.0]), (2, [-3e6, 5.0]), (3, [0.25, 1.0])])
    assert {r.vec_id: r.deviation for r in small} == {i: d[0][0] for i, d in whitened_brute([(1, [1e6, 0.0]), (2, [-3e6, 5.0]), (3, [0.25, 1.0])])[2].items()}


@pytest.mark.parametrize("roots", [[5, 5, 5, 1, 0, 0], [1] * 6, [1, 1 - 1e-13, 0.5, 1e-9, 0, 0], [3, 2, 1, 1e-5, 1e-6, 1e-7], [0] * 6])
def test_eigenpairs(roots):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    matrix = q @ np.diag(np.array(roots, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.eigenpairs(matrix, 4)
    size = max(roots) or 1
    kept = sum(r > 1e-13 for r in sorted(roots)[-4:])
    assert len(values) == kept and np.allclose(values, sorted(roots, reverse=True)[:kept], atol=1e-13 * size)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-13 * size) and np.allclose(vectors.T @ vectors, np.eye(kept), atol=1e-12)
    for shift in (-1.0, 0.3, 0.7, 2.5, 9.0):
        assert whitening.inertia(matrix, shift) == sum(r > shift for r in roots)

"""Vectors, addresses, archives, languages, private spans, pseudo-likelihood and the pipeline."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strata.llm import language, near_vectors, private_spans, pseudo_likelihood, urls, warc
from strata.llm.base import ready
from strata.llm.queries import ORACLES, QUERIES
from strata.session import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _ready(spark):
    ready(spark)


def vectors_brute(rows, least=0.98):
    ok = [
        (i, label, np.array(v, float)) for i, (_, v, label) in enumerate(rows)
        if v and label is not None and rows[i][0] is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, x in ok:
        for j, b, y in ok:
            if i < j and a == b and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / np.sqrt((x1 @ x1) * (y1 @ y1)) >= least:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    parent[find(i)] = find(j)
    group = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            group[find(i)] = min(group.get(find(i), d), d)
    out = [(d, links[i], group.get(find(i)) if d is not None else None) for i, (d, _, _) in enumerate(rows)]
    return sorted(((d, n, c, d is None or d == c) for d, n, c in out), key=repr)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 8)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(0, 0.12, 16)], 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], 2) for i in range(5)] + [(200, rows[0][1], 1), (201, [2 * x for x in rows[0][1]], 1)]
    rows += [(300 + i, [float(x) for x in rng.normal(size=16)], 1) for i in range(10)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [nan] * 16, 1), (404, [inf] + [0.0] * 15, 1),
        (405, [None] + [1.0] * 15, 1), (406, rows[0][1], None), (None, rows[0][1], 1), (407, [1.0], 1), (408, [3.0], 1),
        (409, [-1.0], 1), (410, [1e300] * 3, 1), (411, [1e-300] * 3, 1),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, bucket int, n int")
    got = near_vectors.near_vectors(df.repartition(3), Scratch(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == vectors_brute(rows)
    assert near_vectors.near_vectors(df.where("false"), Scratch(spark)).count() == 0


def test_near_vectors_at_the_threshold():
    """Pairs at cosine 0.98 in 64 dimensions meet in a bucket."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = near_vectors.corners(a), near_vectors.corners(b)
    meets = (x[..., :, None] == y[..., None, :]).any((3, 4)).all(2).any(1)
    assert meets.mean() >= 0.998


def test_address_rules(spark):
    pages = [
        "http://a.example.com/en/x", "https://WWW.Example.COM/en/", "http://example.com", "http://com/", "ftp://x.com/de/?q=/en/",
        "http://b.net/es/1#x", "http://net/fr", "http://net/fr/", "http://notexample.com/en/", None, "", "no scheme", "://", "http://?x",
        "x://h.org/a b", "http://a.b.c.d.e.example.com//en/", "http://example.com/en/?u=http://q.net/es/", "http://Éa.com/", "http://net/es/\n/x",
    ]
    rows = [(i, u, "h", "p") for i, u in enumerate(pages)] + [(0, pages[0], "h", "p"), (None, pages[0], "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = urls.judge(df)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    want = sorted(((i, u, *brute(u)) for i, u, _, _ in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    odd = [("com", "/en/ab", "block"), ("x.com", "", "allow"), (None, "/", "block"), ("", "/", "block"), ("com", "/en/ab", "allow")]
    few = spark.createDataFrame([(1, "http://y.com/en/abc"), (2, "http://y.com/en/a"), (3, "http://z.x.com")], "page_id long, url string")
    found = urls.judge(few, odd).select("page_id", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [(1, "com/en/ab", "block"), (2, None, "allow"), (3, "x.com", "allow")]
    assert urls.judge(few, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict <> 'allow'").count() == 0
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_long_stretches_are_swept_with_the_same_spans(monkeypatch):
    field = private_spans.trained()
    bits = ["jo (at) site (dot) com", "(030) 123-4567", "555-123-9876", "4111 1111 1111 1111 10.0.0.1", "1 22 333", "§ 12 (3)", "a@", "x\n", "wörd", "日本語12"]
    for seed in range(3):
        text = " ".join(bits[i] for i in np.random.default_rng(seed).integers(0, len(bits), 120))
        zone = private_spans.zones(text)
        assert len(zone) == 1
        left, right = zone[0]
        grid = private_spans.lattice(text[left:right])
        scores = field.scores(grid)
        sure, _ = field.posterior(grid, scores)
        path = [(s, y) for s, y in field.best(grid, scores) if y]
        want = [(grid.segments[s], y, sure[s, y]) for s, y in path]
        assert want
        for width in (1, 7, 50, 4096):
            monkeypatch.setattr(private_spans, "WINDOW", width)
            swept = private_spans.Swept(text[left:right], field)
            got, behind = swept.path(), swept.behind()
            assert [((i, j), y) for i, j, y, _ in got] == [w[:2] for w in want]
            odds = [np.exp(swept.reach[i, y] + x + behind[j, y] - swept.total) for i, j, y, x in got]
            assert np.allclose(odds, [w[2] for w in want], atol=1e-9)
        monkeypatch.setattr(private_spans, "WINDOW", 64)
        short = private_spans.spans_of(text, field)
        monkeypatch.setattr(private_spans, "WINDOW", 10**9)
        assert short == private_spans.spans_of(text, field)


def test_long_table_of_figures_needs_little_memory():
    import tracemalloc

    field = private_spans.trained()
    text = " ".join(f"{i * 7919 % 90 + 10}" for i in range(6_000))
    private_spans.spans_of(text[:9000], field)
    tracemalloc.start()
    private_spans.spans_of(text, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_archive_round_trip_and_audit(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "z" * (i * 37 % 301)) for i in range(300)]
    rows += [(None, None, None), (7, "http://x/7", "again"), (301, "http://x/\r\n301", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "page_id long, url string, html string, file string")
    clean = warc.fixity(df, Scratch(spark), damage=lambda page, data: data)
    assert clean.count() == len(rows) and clean.where("status <> 'intact'").count() == 0
    found = warc.fixity(df, Scratch(spark))
    bad = {r.page_id for r in found.where("status = 'changed'").collect()}
    assert bad == {i for i in range(302) if i * 7919 % 97 == 13} and found.count() == len(rows)

    def lose(page, data):
        return b"" if page == 299 else data[:60] + b"?" + data[61:] if page == 5 else data

    lost = warc.fixity(df, Scratch(spark), damage=lose).where("status <> 'intact'").collect()
    assert {r.page_id for r in lost if r.status == "changed"} >= {5} and any(r.page_id in (299, 301) for r in lost)
    assert warc.fixity(df.where("false"), Scratch(spark)).count() == 0


def test_damaged_archive_files(spark, tmp_path):
    """Flipped, cut, empty, missing and prolonged files give rows, and records keep their own status."""
    ready(spark)
    rng = np.random.default_rng(4)
    rows = [(i, f"http://x/{i}", bytes(rng.integers(97, 123, 50 + i).astype(np.uint8)).decode()) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write_archive(df, Scratch(spark))
    path = files.first().file
    name = path.removeprefix("file:")
    whole = open(name, "rb").read()
    at = [f[0] for f in warc.frames(path)] + [len(whole)]
    assert len(at) == 201

    def flip(where):
        return whole[:where] + bytes([whole[where] ^ 4]) + whole[where + 1 :]

    def of(status, *pages):
        return {p: status for p in pages}

    middle = (at[50] + at[51]) // 2
    cases = {
        "same": (whole, {}),
        "byte40": (flip(40), of("unreadable", 0)),
        "mark": (flip(at[7]), of("unreadable", 7)),
        "middle": (flip(middle), of("unreadable", 50)),
        "two": (whole[: at[3] + 20] + bytes(at[5] - at[3] - 40) + whole[at[5] - 20 :], of("unreadable", 3, 4)),
        "cut": (whole[:middle], of("unreadable", 50) | of("missing", *range(51, 200))),
        "lost": (whole[: at[9]] + whole[at[10] :], of("missing", 9)),
        "empty": (b"", of("missing", *range(200))),
        "none": (None, of("missing", *range(200))),
    }
    kinds = "file string, path string"
    listed, theirs = [], []
    for case, (data, _) in cases.items():
        listed.append((case, path))
        theirs.append((case, str(tmp_path / case)))
        if data is not None:
            (tmp_path / case).write_bytes(data)
    scratch = Scratch(spark)
    ours = warc.leaves(spark.createDataFrame(listed, kinds), scratch)
    copies = warc.leaves(spark.createDataFrame(theirs, kinds), scratch)
    got = {case: {} for case in cases}
    for r in warc.audit(ours, copies, scratch).collect():
        assert r.page_id not in got[r.file]
        got[r.file][r.page_id] = r.status
    assert got == {case: want for case, (_, want) in cases.items()}
    back = {case: {} for case in cases}  # the other way round: what only the good copy has is extra
    for r in warc.audit(copies, ours, scratch).collect():
        back[r.file].setdefault(r.status, []).append(r.their_offset if r.page_id is None and r.seq is None else r.seq)
    assert back["same"] == {} and len(back["empty"]["extra"]) == 200 and len(back["lost"]["extra"]) == 1
    assert set(back["middle"]) == {"unreadable", "extra"} and len(back["cut"]["extra"]) == 150
    assert not any("changed" in b for b in back.values())


def test_frames_of_long_and_foreign_files(tmp_path):
    import zstandard

    packer = zstandard.ZstdCompressor(write_checksum=True)
    long = bytes(np.random.default_rng(1).integers(0, 256, 3_000_000).astype(np.uint8))
    parts = [packer.compress(x) for x in (b"a", long, b"", b"c" * 10)]
    path = str(tmp_path / "f")

    def read(data):
        with open(path, "wb") as out:
            out.write(data)
        return [(place, stored, x) for place, stored, x, _ in warc.frames(path)]

    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    good = [(a, b - a, x) for a, b, x in zip(at, at[1:], (b"a", long, b"", b"c" * 10), strict=False)]
    assert read(b"".join(parts)) == good
    hurt = bytearray(b"".join(parts))
    hurt[at[1] + 2_000_000] ^= 1
    assert read(bytes(hurt)) == [good[0], (*good[1][:2], None), *good[2:]]
    junk = b"no archive at all" * 10_000
    assert read(junk) == [(0, len(junk), None)]
    assert read(junk + parts[0]) == [(0, len(junk), None), (len(junk), len(parts[0]), b"a")]
    assert read(parts[0] + b"x") == [good[0], (len(parts[0]), 1, None)]
    assert read(b"") == [] and list(warc.frames(str(tmp_path / "gone"))) == []


def test_only_differing_branches_are_read(spark):
    import pyarrow as pa

    leaf = [("f", i, i * 10, 10, i, bytes([i % 251])) for i in range(1000)]
    schema = "file string, seq long, offset long, length long, page_id long, hash binary"
    other = [(*r[:5], b"x") if r[1] in (17, 18, 999) else r for r in leaf]
    ours, theirs = spark.createDataFrame(leaf, schema), spark.createDataFrame(other, schema)
    got = warc.audit(ours, theirs, Scratch(spark)).orderBy("seq").collect()
    assert [(r.seq, r.status, r.offset) for r in got] == [(17, "changed", 170), (18, "changed", 180), (999, "changed", 9990)]
    short = warc.audit(ours, theirs.where("seq < 990"), Scratch(spark)).collect()
    assert {r.seq for r in short if r.status == "missing"} == set(range(990, 1000))
    assert pa is not None


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    got = language.identify(docs.withColumn("held", language.held_out()), model).where("held")
    right, total = got.where("lang = lang_pred").count(), got.count()
    assert right / total >= 0.97
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the and of with", "x"), (4, "the and of with", "x"), (None, "日本", "x"), (5, "¹ ·", "x")],
        "doc_id long, text string, lang_pred string",
    )
    rows = language.identify(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert [r.lang_pred for r in rows if r.doc_id == 4] == ["en", "en"]
    empty = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    single = language.train(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language.identify(docs.limit(5), single).collect()} == {"de"}


def test_many_languages_are_learned_up_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    monkeypatch.setattr(language, "ROWS", 60)
    docs = spark.createDataFrame(
        [(i, f"{'abcde'[i % 5] * 4} text {i}", f"l{i % 5}") for i in range(300)] + [(1000 + i, f"xyz more {i}", "l4") for i in range(30)], "doc_id long, text string, lang string"
    )
    model = language.train(docs)
    assert len(model.families.names) == 3
    seen = {r.lang_pred for r in language.identify(docs, model).collect()}
    assert seen <= set(model.languages[k].names[0] for k in model.families.names) and "l4" in seen


def test_language_does_not_depend_on_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = docs.select("doc_id", "text")
    alone = {r.doc_id: r.score for r in language.identify(rows.where("doc_id < 4"), model).collect()}
    all_ = {r.doc_id: r.score for r in language.identify(rows.repartition(2), model).collect()}
    assert all(abs(all_[d] - s) < 1e-4 for d, s in alone.items())


def test_private_spans(spark):
    import hashlib
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")

    def brute(text):
        out = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [(m.start(), 2, m.end()) for m in private_spans.CARD.finditer(text) if private_spans._card_ok(m.group())]
        digits = lambda s: sum("0" <= c <= "9" for c in s)
        out += [(m.start(), 3, m.end()) for m in private_spans.PHONE.finditer(text) if 10 <= digits(m.group()) <= 15]
        return sorted(out)

    texts = [
        None, "", "plain words", "a@b a@b.c a@@b.cd@e.f x@y.z.", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4", "٣ ٤@x.y é@ü.c",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485 +12 +49 30 1234567890123456", "+1+1 555 555 5555-",
        "9" * 3000, "a" * 3000 + "@", "@" * 300, "+(" * 300, "1." * 900, "me@x.com" * 20, "7 " * 400, "𝒳 a@b.c",
    ]
    for text in texts:
        assert private_spans.base_spans(text or "") == brute(text or "")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "", 1), (None, "x@y.zz", 1)], "doc_id long, text string, spans int")
    got = private_spans.private_spans(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            base = private_spans.written(brute(texts[r.doc_id] or ""))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert set(base.split(",")) <= set(r.spans.split(","))
    assert private_spans.private_spans(df.where("false")).count() == 0


def test_private_counts_are_of_base_spans(spark):
    texts = ["write to anna.b (at) mail.example (dot) com today", "call (988) 555-2485 or x@y.zz now", "at 10.0.0.1 and +1 988 555 2485"]
    got = private_spans.private_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got}
    assert counts == {0: (0, 0, 0, 0), 1: (1, 0, 0, 0), 2: (0, 1, 0, 1)}
    # what the field adds is listed all the same
    spans = {r.doc_id: r.spans for r in got}
    assert spans[0].startswith("email:9:") and "phone:5:19" in spans[1].split(",")


def test_field_on_unseen_lines():
    field, right, wrong, missed = private_spans.trained(), 0, 0, 0
    for line, marks in private_spans._examples(150, 77):
        _, spans = private_spans.spans_of(line, field)
        gold, got = {(a, y - 1, b) for a, b, y in marks}, set(spans)
        right, wrong, missed = right + len(gold & got), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) >= 0.97 and right / (right + missed) >= 0.93


def test_hidden_forms_in_unspaced_and_long_text():
    field = private_spans.trained()
    hidden, number = "john(at)example(dot)com", "555-123-4567"
    han, kana, thai = "请把所有的文件都发送到这个地址然后等待我们的回复" * 9, "こちらのアドレスまでおくってください" * 9, "กรุณาส่งเอกสารทั้งหมดไปที่" * 9
    for wide in (han, kana, thai):
        for body, kind in ((hidden, 0), (number, 3)):
            text = wide + body + wide
            assert private_spans.spans_of(text, field)[1] == [(len(wide), kind, len(wide) + len(body))]
    # each text lies in its zones as a whole, however near or far the other triggers
    json = ",".join(f'{{"key{k}":"value","list":["a","b"]}}' for k in "abcdefgh" * 9)
    for body, kind in ((hidden, 0), (number, 3)):
        text = f'{json},{{"mail":"{body}"}},{json}'
        at = text.index(body)
        assert (at, kind, at + len(body)) in private_spans.spans_of(text, field)[1]
        assert any(a < at and at + len(body) < b for a, b in private_spans.zones(text))
    # more than 48 characters beyond the at-sign, with and without spaces
    spaced = "anna (at) mathematicsandcomputersciencefacultymail (dot) internationaluniversityexample (dot) org"
    assert private_spans.zones("to " + spaced + " for more") == [(0, len(spaced) + 12)]
    long = "anna(at)mathematicsandcomputersciencefacultymail(dot)internationaluniversityexample.org"
    assert private_spans.spans_of("please write to " + long + " for more of it", field)[1] == [(16, 0, 16 + len(long))]
    # a trigger within another's reach extends the zone
    text = "7 " + "word " * 9 + "bob (at) " + "verylongname" * 5 + ".example.com and more"
    (zone,) = private_spans.zones(text)
    assert zone == (0, len(text))


def test_zones_hold_all_entities():
    import random

    rng = random.Random(3)
    for _ in range(300):
        parts = ["ab", " ", "7", "@", "(at)", "文字", ".", "-", "x" * 60, "\n", "é", "น้ำ"]
        text = "".join(rng.choices(parts, weights=[9, 9, rng.random(), rng.random(), rng.random(), 3, 3, 3, 2, 1, 2, 2], k=400))
        cuts = {0, len(text)} | {m.end() for m in private_spans._TOKEN.finditer(text)}
        found, ends = private_spans.zones(text), sorted(cuts)
        assert all(a in cuts and b in cuts for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        for m in private_spans._TRIGGER.finditer(text):
            i, j = ends.index(m.start()), ends.index(m.end())
            low, high = ends[max(0, i - private_spans.LONGEST)], ends[min(len(ends) - 1, j + private_spans.LONGEST)]
            assert any(a <= low and high <= b for a, b in found)


def test_field_probabilities_against_enumeration():
    """The sums of the dynamic programme equal those over all labelled segmentations."""
    rng = np.random.default_rng(0)
    field = private_spans.Field(rng.normal(0, 0.3, (5, private_spans.TABLE)), rng.normal(0, 0.3, (5, 5)))
    grid = private_spans.lattice("a 1@b")
    scores, n = field.scores(grid), len(grid.tokens)
    total, mass = 0.0, np.zeros_like(scores)

    def walk(at, label, value, path):
        nonlocal total
        if at == n:
            total += np.exp(value)
            for s, y in path:
                mass[s, y] += np.exp(value)
            return
        for s, (i, j) in enumerate(grid.segments):
            if i == at:
                for y in range(5):
                    if np.isfinite(scores[s, y]):
                        walk(j, y, value + scores[s, y] + field.after[label, y], [*path, (s, y)])

    walk(0, 0, 0.0, [])
    sure, pairs = field.posterior(grid, scores)
    assert np.allclose(sure, mass / total) and np.isclose(pairs.sum(), sure.sum())


def test_redaction():
    text = "mail a@b.cc now, 4111111111111111"
    spans = private_spans.base_spans(text)
    assert private_spans.redacted(text, spans) == "mail <EMAIL> now, <CARD>"
    assert private_spans.redacted("x", []) == "x"


def test_pseudo_likelihood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = pseudo_likelihood.vocabulary(docs)
    assert len(words.hashes) == len(set(words.ids.tolist())) <= words.shape.frequent and words.counts.sum() == words.total
    weights = pseudo_likelihood.train(docs, words)
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, words, weights).collect()}

    def mean(rows):
        return sum(r.log_likelihood for r in rows) / sum(r.n_words for r in rows)

    # the start predicts by frequency alone, and training adds to that
    by_counts = pseudo_likelihood.score(docs, words, pseudo_likelihood.initial(words.shape, words.counts)).collect()
    shares = words.counts[words.counts > 0] / words.total
    assert np.isclose(mean(by_counts), (shares * np.log(shares)).sum(), atol=0.02)
    assert mean(got.values()) > mean(by_counts) + 0.02
    # a plain softmax over all ids, word by word
    import re

    import pyarrow as pa

    text = docs.where("doc_id = 3").first().text
    v = pseudo_likelihood.views(weights, words.shape)
    (part,) = pseudo_likelihood._hashed(pa.array([text]))
    ids = part.ids(words)
    total = 0.0
    for p in part.place:
        context = np.concatenate([v["embed"][ids[p + d]] for d in (-2, -1, 1, 2)])
        hidden = np.tanh(context @ v["inner"] + v["inner_bias"])
        kind = hidden @ v["to_class"] + v["class_bias"]
        kind = np.log(np.exp(kind) / np.exp(kind).sum())
        inner = hidden @ v["to_word"] + v["word_bias"]
        inner = inner - np.log(np.exp(inner).sum(1, keepdims=True))
        full = (kind[:, None] + inner).ravel()
        assert np.isclose(np.exp(full).sum(), 1, atol=1e-4)
        total += full[ids[p]]
    assert got[3].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
    assert np.isclose(got[3].log_likelihood, total, rtol=1e-4)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "a"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    rows = pseudo_likelihood.score(odd, words, weights).collect()
    assert len(rows) == 6 and all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in rows)
    none = pseudo_likelihood.pseudo_likelihood(odd.where("false"), Scratch(spark))
    assert none.count() == 0


def test_rare_words_are_scored_as_themselves(spark, monkeypatch):
    """log P(word) = log P(group) + log(n / (N + 1)), counted by hand; both ways of getting n."""
    import pyarrow as pa

    monkeypatch.setattr(pseudo_likelihood.Shape, "of", classmethod(lambda cls, n: cls(8, 62)))  # two frequent words, all others in groups
    monkeypatch.setattr(pseudo_likelihood, "HEAD", 20)

    def hashed(text):
        (part,) = pseudo_likelihood._hashed(pa.array([text]))
        return part

    def hashes(text):
        return hashed(text).hashes.view(np.int64).tolist()

    rows = [(i, "the of " * 30 + " ".join(f"w{j}" for j in range(400) if i % (1 + j % 7) == 0)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = pseudo_likelihood.word_counts(docs).persist()
    n = {r.hash: r.n for r in counted.collect()}
    words = pseudo_likelihood.vocabulary(docs, counted)
    weights = pseudo_likelihood.initial(words.shape)
    odd = [(50, "w3"), (50, "w3"), (51, "the"), (52, "neverseen w0 w5"), (None, "w6 w6 w6"), (53, None)]
    asked = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(4)
    plain, full = (
        sorted(tuple(-1 if x is None else x for x in r) for r in pseudo_likelihood.score(asked, words, weights, *more).collect())
        for more in ((), (counted, Scratch(spark)))
    )
    groups = {h: int(g) for _, t in rows + odd if t for h, g in zip(hashes(t), words.encode(hashed(t).hashes, hashed(t).endings), strict=True)}
    totals = {g: sum(n.get(h, 0) for h, own in groups.items() if own == g) for g in set(groups.values())}
    want = {}
    for i, text in rows + odd:
        want[-1 if i is None else i] = sum(
            np.log(n.get(h, 1) / (totals[groups[h]] + 1)) for h in (hashes(text) if text else []) if groups[h] >= 2
        )
    assert [r[:2] for r in plain] == [r[:2] for r in full] and len(full) == len(rows) + len(odd)
    for a, b in zip(plain, full, strict=True):
        assert np.isclose(b[2] - a[2], want[a[0]], atol=1e-6)
        assert b[1] == 0 or np.isclose(b[3], b[2] / b[1])
    # the query itself does so: two texts that differ in a rare word of one group differ in their sums
    same = next((a, b) for a in range(400) for b in range(a) if a % 7 == 0 and b % 7 == 6 and groups[hashes(f"w{a}")[0]] == groups[hashes(f"w{b}")[0]] >= 2)
    docs = docs.union(spark.createDataFrame([(100 + k, f"w{j}") for k, j in enumerate(same)], docs.schema))
    got = {r.doc_id: r.log_likelihood for r in pseudo_likelihood.pseudo_likelihood(docs, Scratch(spark)).where("doc_id >= 100").collect()}
    assert abs(got[100] - got[101]) > 0.5


def test_every_word_is_a_training_target_once(spark, monkeypatch):
    import pyarrow as pa

    texts = ["one", "a b", None, "", "x y z", " ".join(f"w{i}" for i in range(41))] * 7
    shard = [0] * 20 + [1] * 22
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(shard, pa.int32())], ["text", "shard"])
    shape = pseudo_likelihood.Shape.of(0)
    words = pseudo_likelihood.Vocabulary(shape, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(shape.size, np.int64), 0)
    seen = []
    monkeypatch.setattr(pseudo_likelihood._Learner, "_step", lambda self, context, target, rate: seen.append((context, target)))
    n = 0
    for turn in range(pseudo_likelihood.ROUNDS):
        # the second round gets other batches, which leave the choice within a text as it is
        batches = [batch] if turn == 0 else [batch.slice(0, 3), batch.slice(3, 30), batch.slice(33)]
        out = list(pseudo_likelihood._trained(iter(batches), words, pseudo_likelihood.initial(shape), turn, pseudo_likelihood.ROUNDS))
        assert len(out) == 2  # one result a shard
        n += sum(o.column("value").to_pylist()[-1] for o in out)
    assert n == 7 * (1 + 2 + 3 + 41) == sum(len(t) for _, t in seen)
    got = sorted(tuple(c) + (t,) for context, target in seen for c, t in zip(context.tolist(), target.tolist(), strict=True))
    (part,) = pseudo_likelihood._hashed(batch.column("text"))
    ids = part.ids(words)
    want = sorted(tuple(c) + (t,) for c, t in zip(pseudo_likelihood._context(ids, part.place).tolist(), ids[part.place].tolist(), strict=True))
    assert got == want
    # a corpus of one-word texts trains too
    short = spark.createDataFrame([(i, "one") for i in range(9)], "doc_id long, text string").repartition(3)
    monkeypatch.undo()
    found = pseudo_likelihood.vocabulary(short)
    assert not np.array_equal(pseudo_likelihood.train(short, found), pseudo_likelihood.initial(found.shape, found.counts))


def test_training_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = []
    for parts in (1, 32):
        rows = pseudo_likelihood.pseudo_likelihood(docs.repartition(parts), Scratch(spark)).collect()
        sums.append(np.array(sorted((r.doc_id, r.n_words, r.log_likelihood) for r in rows)))
    assert np.allclose(*sums, rtol=1e-4)


def test_training_on_encoded_texts(monkeypatch):
    """Ids written once give the training the same words as the texts do."""
    import pyarrow as pa

    texts = ["one", "a b", None, "", "x y z", "...", " ".join(f"w{i}" for i in range(3000))] * 3
    shard, draw = pa.array([0] * 10 + [1] * 11, pa.int32()), pa.array(range(21), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(texts), shard, draw], ["text", "shard", "draw"])
    shape = pseudo_likelihood.Shape(256, 60000)
    words = pseudo_likelihood.Vocabulary(shape, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(shape.size, np.int64), 0)
    encoded = list(pseudo_likelihood._encoded(iter([batch.slice(0, 3), batch.slice(3)]), words))
    assert [x for b in encoded for x in b.column("draw").to_pylist()] == list(range(21))
    seen = []
    monkeypatch.setattr(pseudo_likelihood._Learner, "add", lambda self, context, target: seen[-1].append(np.column_stack([context, target])))
    for batches in ([batch], encoded):
        seen.append([])
        list(pseudo_likelihood._trained(iter(batches), words, np.zeros(shape.n_weights, np.float32), 1, pseudo_likelihood.ROUNDS))
    plain, coded = (np.concatenate(x) for x in seen)
    assert np.array_equal(plain, coded) and plain.max() > 1 << 15


def test_held_out_text_beats_word_frequencies(spark):
    """On sf0.1, by 0.3 nats a word at least."""
    docs = Scratch(spark).table(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(32))
    held = "pmod(xxhash64(text), 10) = 0"
    seen, kept = docs.where(f"not ({held})"), docs.where(held)
    words = pseudo_likelihood.vocabulary(seen)

    def mean(weights):
        row = pseudo_likelihood.score(kept, words, weights).selectExpr("sum(log_likelihood) / sum(n_words)").first()
        return row[0]

    assert mean(pseudo_likelihood.train(seen, words)) > mean(pseudo_likelihood.initial(words.shape, words.counts)) + 0.3


def test_the_vocabulary_grows_with_the_corpus():
    sizes = [pseudo_likelihood.Shape.of(n).size for n in (0, 10**5, 10**7, 10**9, 10**15)]
    assert sizes == sorted(sizes) and sizes[0] >= 64 and sizes[-1] <= 66_000 < 10 * sizes[3]


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    shape = pseudo_likelihood.Shape(16, 64)
    learner = pseudo_likelihood._Learner(shape, pseudo_likelihood.initial(shape))
    context = rng.integers(0, 40, (512, 4))
    target = (context[:, 1] * 7 + context[:, 2]) % 50
    losses = []
    for _ in range(60):
        losses.append(-pseudo_likelihood.log_probabilities(pseudo_likelihood.views(learner.weights, shape), context, target).mean())
        learner._step(context, target, 0.05)
    assert losses[-1] < 0.6 * losses[0]


def test_scoring_in_blocks_and_with_large_logits(monkeypatch):
    """Blocks of any size and logits beyond single precision's exp give a plain softmax's results."""
    rng = np.random.default_rng(5)
    shape = pseudo_likelihood.Shape(9, 20)
    context, target = rng.integers(0, shape.size + 1, (700, 4)), rng.integers(0, shape.size, 700)
    for scale in (1, 200):
        v = pseudo_likelihood.views(rng.normal(0, 1, shape.n_weights).astype(np.float32) * scale, shape)
        hidden = np.tanh(v["embed"][context].reshape(700, -1) @ v["inner"] + v["inner_bias"]).astype(float)
        want = np.zeros(700)
        for logits, right in (
            (hidden @ v["to_class"] + v["class_bias"], target // 9),
            (np.einsum("nh,nhw->nw", hidden, v["to_word"][target // 9]) + v["word_bias"][target // 9], target % 9),
        ):
            logits = logits - logits.max(1, keepdims=True)
            want += logits[np.arange(700), right] - np.log(np.exp(logits).sum(1))
        for block in (1, 900, pseudo_likelihood.BLOCK):
            monkeypatch.setattr(pseudo_likelihood, "BLOCK", block)
            got = pseudo_likelihood.log_probabilities(v, context, target)
            assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-3, atol=1e-3)
            monkeypatch.undo()


def test_words_that_share_their_first_bits_are_found():
    few = np.array([0, 1, 2, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    for among in (few[:0], few, np.arange(3, 3000, 7, dtype=np.uint64), np.arange(1, 2000, dtype=np.uint64) << np.uint64(53)):
        asked = np.concatenate([among[::2], few, among + np.uint64(3)])
        found, at = pseudo_likelihood._find(among, asked)
        assert found.tolist() == np.flatnonzero(np.isin(asked, among)).tolist()
        assert np.array_equal(among[at], asked[found])


PIPE = "doc_id long, text string, lang string, source string, n_chars long, extra string, bucket int"


def test_pipeline_stages(spark, tmp_path):
    import re

    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "e", 1) for r in real]
    base = next(r.text for r in real if len(r.text.split()) > 60 and "@" not in r.text)
    rows += [
        (9001, None, "en", "s", 0, None, 1), (9002, "", "en", "s", 0, None, 1), (9003, "12 34 ..", "en", "s", 8, None, 1),
        (9004, base + " tail", "en", "s", 0, None, 1), (9004, base + " tail", "en", "s", 0, None, 1),
        (9005, "see " + item + " here it ends", None, None, 0, None, 1), (None, "the writer is me.1@mail.example.com of the house", "en", None, 0, None, 1),
    ]
    folder = str(tmp_path)
    spark.createDataFrame(rows, PIPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "minhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing",
    ]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
    ids = {n: [r.doc_id for r in own] for n, own in seen.items()}
    assert not {9001, 9002, 9003} & set(ids["language_id"]) and len(ids["language_id"]) == len(rows) - 3
    assert 9004 not in ids["minhash_near_dedup"] and None in ids["minhash_near_dedup"]
    assert 9005 in ids["minhash_near_dedup"] and 9005 not in ids["benchmark_decontamination"]
    assert len(ids["pii"]) == len(ids["benchmark_decontamination"])
    texts = [r.text for r in seen["pii"]]
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t) for t in texts)
    assert any("<EMAIL>" in t for t in texts) and all(r.n_chars == len(r.text) for r in seen["pii"])
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == set(ids["pii"])


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None), (2, "文字", None), (3, "12 ..", None), (4, "", None), (5, None, None), (None, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert {r.text for r in kept} == {"some words", "文字", "é"} and len(kept) == 3


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_pipeline_keys_and_empty_tables(spark, tmp_path):
    """A text that shares another's number is a document of its own; empty tables pass through."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    same, other = "one two three four five six seven eight nine ten", "quite another text with words of its own kind here today"
    rows = [(1, same, "en", "s", 1), (2, same, "en", "s", 1), (2, other, "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} - {(3, None)} in ({(1, same), (2, other)}, {(2, same), (2, other)})
    spark.createDataFrame([("b", same)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in left} == {(2, other), (3, None)}
    for name, table in (("a", docs), ("b", docs.where("false"))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        assert (len(packed) > 0) == (name == "a")


def test_near_dedup_meets_the_texts_with_written_tables(spark):
    """The numbers to drop are a table of their own, and texts are read for at most one join with it."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, f"{i} two three four five six seven eight", "en", "s", 1) for i in range(20)], schema)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("n_shingles") == 0
    assert left.count() == 20


def test_scratch_tables_go_with_their_stage(spark):
    from strata import session

    before = list(session._OPEN)
    with session.closing():
        scratch = Scratch(spark)
        held = scratch.table(spark.range(3))
        assert held.count() == 3
    assert session._OPEN == before
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

"""Operators on documents against brute force, over the cases that break such jobs."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import blocks, bpe, near_text, overlap, packing, token_files
from strata.llm.base import ready
from strata.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, component_id int, a int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rng_words(seed, n, size=4000):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, size, n)]


def texts():
    base = rng_words(1, 90)
    out = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "é É ñ one"]
    out += [" ".join(base), " ".join(base), " ".join(base).upper()]
    for edits in range(1, 14):  # a family around one text, on both sides of the threshold
        rng = np.random.default_rng(edits)
        own = list(base)
        for i in rng.choice(len(own), edits, replace=False):
            own[i] = f"x{edits}_{i}"
        out.append(" ".join(own))
    out += [" ".join(rng_words(9, 5000)), "be " * 3000, "be " * 2999]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    rows = [(i, t, "en", "s", 0, "x", 1, 2) for i, t in enumerate(texts())]
    rows += [rows[8], rows[8], (None, texts()[8], "en", "s", 0, "x", 1, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets:
        for e, t in sets:
            if d is not None and e is not None and s and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted(
        ((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr
    )


def test_near_text(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_text.near_duplicates(docs, Scratch(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == near_brute(rows)
    assert near_text.near_duplicates(docs.where("false"), Scratch(spark)).count() == 0


def test_near_text_chain_of_many(spark):
    """A long chain whose ends are far apart is one component; a chunked bucket loses no link."""
    ready(spark)
    base = rng_words(3, 120)
    rows = [(1000 - i, " ".join(base[:60] + [f"y{j}" for j in range(i, i + 60)])) for i in range(0, 120, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_text.near_duplicates(df, Scratch(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == near_brute(rows)


def test_small_sets_lose_no_link():
    """Every pair that is similar enough shares a key where the smaller set is small."""
    rng = np.random.default_rng(8)
    for percent in (51, 60, 75, 90, 100):
        for _ in range(3000):
            n = int(rng.integers(2, near_text.SMALL + 1))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            swap, more = int(rng.integers(0, 3)), int(rng.integers(0, 6))
            kept = rng.permutation(a)[swap:]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, more).astype(np.uint64)]))
            both = len(set(a.tolist()) & set(b.tolist()))
            if min(len(a), len(b)) < 2 or 100 * both < percent * (len(a) + len(b) - both):
                continue
            x, y = near_text.small_keys(a, percent), near_text.small_keys(b, percent)
            assert set(x.tolist()) & set(y.tolist())
    assert len(near_text.small_keys(np.arange(22, dtype=np.uint64), 75)) == 0
    assert len(near_text.small_keys(np.arange(1, dtype=np.uint64), 75)) == 0


def test_near_text_of_short_texts(spark):
    ready(spark)
    rng = np.random.default_rng(5)
    rows = []
    for family in range(150):  # texts of 7 to 20 words, cut or prolonged by one
        own = [f"f{family}_{i}" for i in range(int(rng.integers(7, 21)))]
        for k, t in enumerate((own, own[:-1], own[1:], [*own, "z"], [*own[:-1], "y"])):
            rows.append((family * 10 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_text.near_duplicates(df, Scratch(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == near_brute(rows)
    with pytest.raises(ValueError):
        near_text.near_duplicates(df, Scratch(spark), percent=50)


@pytest.mark.parametrize("main", [0, 1, 40])
def test_strays_meet_all_and_others_only_strays(spark, main):
    rows = [("b", i, i >= main, 50 - main, main) for i in range(50)]
    df = spark.createDataFrame(rows, "bucket string, doc_id long, stray boolean, strays long, others long")
    met = {}
    for r in blocks.apart(df, ["bucket"], "doc_id", 8).collect():
        met.setdefault((r.low, r.high), []).append((r.doc_id, r.mine))
    pairs = []
    for (low, high), members in met.items():
        for i, (d, m) in enumerate(members):
            pairs += [tuple(sorted((d, e))) for e, k in members[:i] if low == high or m != k]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in range(50) for b in range(a + 1, 50) if b >= main}
    assert not any(b < main for _, b in pairs)


def test_parity_bitmap_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 400):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 2 + 1).astype(np.uint64)]))
        x, y = (np.frombuffer(near_text.parity(s), np.uint64)[None, :] for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = near_text._halved(x)
        while y.shape[1] > x.shape[1]:
            y = near_text._halved(y)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def overlap_brute(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own is not None:
                    found |= own
                    hit.update(range(k, k + n))
        names = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = len(found - {None})
        out.append((d, len(w), len(hit), n_items, hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_overlap(spark):
    ready(spark)
    item = rng_words(5, 30)
    items = [
        (1, " ".join(item)), (2, " ".join(item)), (10, "Short Item here"), (11, ""), (12, None), (13, "one"),
        (14, "same " * 14), (15, "é-ñ, ß"), (None, " ".join(rng_words(6, 12))), (16, " ".join(item[5:17])),
    ]
    filler = rng_words(7, 40)
    docs = [
        (0, None), (1, ""), (2, "..."), (3, " ".join(filler)), (4, " ".join(filler + item[3:13] + filler)),
        (5, " ".join(filler + item[3:12] + filler)), (6, " ".join(item).upper() + "! " + " ".join(item)),
        (7, "a short, item HERE b"), (8, "same " * 40), (9, "same " * 9), (10, "É one é ñ ß"), (11, "x é ñ ß y"),
        (12, " ".join(rng_words(6, 12))), (4, " ".join(filler + item[3:13] + filler)), (None, " ".join(item)),
        (13, " ".join(item[k] for k in range(9)) + " zzz " + " ".join(item[9:])),
    ]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, row int, at int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")
    got = overlap.decontaminated(df, bench, Scratch(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == overlap_brute(docs, items)
    nothing = overlap.decontaminated(df, bench.where("false"), Scratch(spark))
    assert nothing.where("contaminated or n_items > 0").count() == 0 and nothing.count() == len(docs)
    assert overlap.decontaminated(df.where("false"), bench, Scratch(spark)).count() == 0


def test_winnowing_guarantee():
    """Any shared run of ten words keeps a fingerprint of its own."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        hashes = rng.integers(0, 6, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        kept = overlap.winnow(hashes, np.array([0, 60]))
        for k in range(51):
            assert ((kept >= k) & (kept <= k + 5)).any()


ODD = [
    "", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "a\n \n b", "<|endoftext|> x<|endoftext|>", "a\x00b c", "\0", "\0 a", "a \0",
    "\x1c x\x1dy z", "É É́ é", "x y\xa0z", "İ Σ ΑΣ ", "it's we'll DON'T", "1234 5,6", "a\t b", " ́ x", "x!!! y?? (z)", "ﬁ ª µ",
]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_library(name, spaces, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary(name))
    library.encode_special_tokens = True
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)  # forgets all the time
    coder = bpe.Encoder(bpe.vocabulary(name), spaces)
    for _ in range(2):
        for group in (ODD, [t or "" for t in texts()][:12], ODD[::-1]):
            ids, bounds = coder.encode(group)
            assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == [
                library.encode(t, add_special_tokens=False).ids for t in group
            ]


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_packed_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, 1000) == ids).all()
    assert len(token_files.pack(ids, bits)) == -(-1000 // 64) * bits * 8


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50257, 3 * token_files.BLOCK + 77).astype(np.uint32)
    writer = token_files.TokenWriter(str(tmp_path / "x.tok"), 16)
    writer.add(np.array([5]), np.array([False]), ids[:10], np.array([0, 10]))
    writer.add(np.array([6, 0]), np.array([False, True]), ids[10:], np.array([0, 0, len(ids) - 10]))
    assert writer.close() == (3, len(ids))
    reader = token_files.TokenReader(str(tmp_path / "x.tok"))
    assert list(reader.docs) == [5, 6, 0] and list(reader.nulls) == [False, False, True]
    for a, b in ((0, 1), (9, 12), (token_files.BLOCK - 1, token_files.BLOCK + 1), (100, 100), (0, len(ids)), (40000, len(ids))):
        assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_files.TokenWriter(str(tmp_path / "y.tok"), 4).add(np.array([1]), np.array([False]), np.array([16], np.uint32), np.array([0, 1]))


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    scratch = Scratch(spark)
    got = token_files.read_tokens(token_files.write_tokens(docs, scratch)).collect()
    want, rows = {}, docs.select("doc_id", "text").collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(
        (d, *x) for d, own in want.items() for x in own if d is not None
    )
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert token_files.read_tokens(token_files.write_tokens(docs.where("false"), scratch)).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    got = packing.pack_documents(docs, Scratch(spark)).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want.append((r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    check_seats([(r.sequence_id, r.offset, r.length) for r in got])
    assert packing.pack_documents(docs.where("false"), Scratch(spark)).count() == 0


def check_seats(seats):
    rows = {}
    for sequence, offset, length in seats:
        rows.setdefault(sequence, []).append((offset, length))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_sequences(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 60), rng.integers(1, 400, 60))}
    runs = packing.plan(counts)
    seats = []
    for length, rank, n, each, first, offset in runs.tolist():
        seats += [(first + i // each, offset + i % each * length, length) for i in range(n)]
    assert {k: sum(1 for s in seats if s[2] == k) for k in counts} == counts
    used = check_seats(seats)
    least = max(-(-sum(k * n for k, n in counts.items()) // 2048), sum(n for k, n in counts.items() if k > 1024))
    assert least <= used <= least * 1.23 + 1  # best fit stays within 11/9 of the least
    assert len(runs) <= 4 * 2048 * 11
    assert len(packing.plan({})) == 0


def test_flat_reads_slices_and_nulls():
    import pyarrow as pa

    from strata.llm.text import flat

    body, offsets = flat(pa.array(["ab", None, "", "ü"]).slice(1))
    assert bytes(body).decode() == "ü" and list(offsets) == [0, 0, 0, 2]
    assert list(flat(pa.array([], pa.string()))[1]) == [0]


def test_components(spark):
    from strata.llm.components import components

    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (500, 500), (None, 3), (700, 600)]
    df = spark.createDataFrame(chain, "a long, b long").repartition(4)
    got = {r.id: r.component for r in components(df, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400, 600: 600, 700: 600}
    assert components(df.where("false"), Scratch(spark)).select(F.col("id")).count() == 0

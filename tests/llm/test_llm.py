"""The corpus operators against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fileloom.llm import language_crf, lz_fingerprint, mixing, ngram_join, packing, quality_rules, record_files, sharding, suffix_dedup, toxicity
from fileloom.llm.common import discard, slices
from fileloom.llm.encoding import PLAIN, CachedEncoder
from fileloom.llm.wordblocks import Block

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module", autouse=True)
def tidy(spark):
    yield
    discard(spark)


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages, nulls, empty texts and repeated rows."""
    rng, words = random.Random(seed), vocabulary(seed)
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        kind, base = i % 6, text(rng.randint(1, 220))
        if kind == 1 and rows and rows[-1][1]:
            base = rows[-1][1]
        elif kind == 2 and rows and rows[-2][1]:
            near = rows[-2][1].split()
            near[rng.randrange(len(near))] = "zz"
            base = " ".join(near)
        elif kind == 3:
            base = f"{text(30)} {passage}\n{text(20)}"
        rows.append((i, base, ("en", "de", None)[i % 3], ("s1", "s2", "s3", None)[i % 4], len(base)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", "s9", 4), (n + 3, "Ünï ßtraße <|endoftext|> 日本  x", "de", "s2", 30), rows[3], (None, text(90), None, "s1", 9), (None, None, None, "s1", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def own_names(df):
    """Extra columns with the names that operators give to columns of their own."""
    from pyspark.sql import functions as F

    names = "doc digest cuts kept_id kept_digest many id turn copies _id _copies _source _digest anchor positions node key token labelled toxic held_out text2 part curve"
    return df.withColumns({x: F.lit("x") for x in names.split()})


def clashing(df):
    """Extra columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({x: F.lit("x") for x in ("shard", "size", "hi", "label", "score", "curve", "part", "grp", "salt", "block", "digest", "doc", "start")})


def test_only_tables_without_readers_are_dropped(spark):
    from fileloom.llm import common

    first = common.materialize(spark.range(10), "first")
    second = common.materialize(first.filter("id > 4"), "second")
    written = len(common._written)
    common.drop(first, first, spark.range(1))
    assert second.count() == 5 and len(common._written) == written - 1


def test_slices_cover_all():
    column = pa.array(["a" * 10, None, "", "b" * 100, "c"])
    assert [k for lo, hi in slices(column, 20) for k in range(lo, hi)] == [0, 1, 2, 3, 4]
    assert list(slices(pa.array([], pa.string()))) == []


def test_order_by_equals_a_sort_by_two_keys():
    from fileloom.llm.wordblocks import order_by

    rng = np.random.default_rng(6)
    near = np.uint64(1 << 60) + rng.integers(0, 1 << 10, 500).astype(np.uint64)  # values that differ in the last bits only
    for owner, value in ((rng.integers(0, 9, 500), rng.integers(0, 1 << 63, 500).astype(np.uint64)), (rng.integers(0, 3, 500), near), (rng.integers(0, 1 << 30, 500), near), (np.zeros(0, np.int64), near[:0])):
        order, want = order_by(owner, value), np.lexsort((value, owner))
        assert (owner[order] == owner[want]).all() and (value[order] == value[want]).all() and sorted(order.tolist()) == list(range(len(owner)))


def test_words_and_hashes():
    texts = ["a b\x0ba", None, "", " x y ", "A"]
    block = Block.of(pa.array(texts))
    starts, ends, first = block.words()
    got = [[bytes(block.data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [WORD.findall(x or "") for x in texts]
    h, low = block.hashes(starts, ends), block.hashes(starts, ends, lower=True)
    assert h[0] == h[2] and h[0] != h[1] and h[0] != h[-1] and low[0] == low[-1]


# --- 8 --------------------------------------------------------------------


def quality_base(text):
    words = WORD.findall(text or "")
    tri = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, t in enumerate(zip(words, words[1:], words[2:])) if tri[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def js(p, q):
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_quality_base_counts(spark, docs):
    noisy = spark.createDataFrame([(1, "a b c a b c x\na b c\n\na b c\n \n a b c", None, None, 0), (2, "#x <y> | * a", None, None, 0), (3, "日本 é" * 40, None, None, 0)], SCHEMA)
    rows = docs.union(noisy)
    got = quality_rules.score_quality(clashing(rows)).collect()
    want = [(r.doc_id, *quality_base(r.text)) for r in rows.collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_measured_references(spark, empty):
    words, rows = tongues(5, 300)
    rows = [(i, f"{t} {t.title()}, {' '.join(words[lang][(i * 7 + k) % 150] for k in range(60))}.", lang, s, 0) for i, t, lang, s, _ in rows]
    df = clashing(spark.createDataFrame([*rows, (900, None, "aa", None, 0), (None, "x " * 90, "bb", None, 0), (901, "few", "cc", None, 0)], SCHEMA))
    refs = quality_rules.measured(df, sample=60)
    assert refs.languages == ["aa", "bb"] and all(abs(q.sum() - 1) < 1e-9 for q in (*refs.classes, *refs.words))
    texts = [r[1] for r in rows]
    kept = quality_rules.measure(pa.array(texts), refs)
    assert kept["kept"].mean() > 0.95 and [refs.languages[k] for k in kept["closest"]] == [r[2] for r in rows]
    assert not quality_rules.measure(pa.array([x.upper().replace(" ", " ## ") for x in texts]), refs)["kept"].any()
    assert quality_rules.measured(empty).languages == quality_rules.References().languages


def test_quality_of_other_scripts():
    refs = quality_rules.References()
    russian = "Съешь же ещё этих мягких французских булок, да выпей чаю; потом мы пошли домой и долго говорили о том, что было раньше " + " ".join(f"слово{chr(0x430 + i % 30)}{chr(0x430 + i // 7)}" for i in range(60))
    m = quality_rules.measure(pa.array([russian, russian + " plain", "“quoted” — text… " * 30]), refs)
    assert m["kept"].tolist()[:2] == [True, True] and m["closest"].tolist()[:2] == [-1, -1] and m["closest"][2] >= 0


def test_quality_distances_by_hand():
    refs = quality_rules.References()
    text = "The cat, and the dog of it. " * 3 + "Ünïcode 12"
    m = quality_rules.measure(pa.array([text]), refs)
    kinds = np.zeros(7)
    for c in text:
        kinds[0 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?'\"()-" else 1 if 191 < ord(c) < 0x2000 or 0x2FFF < ord(c) < 0x10000 else 6] += 1
    language = refs.languages[m["closest"][0]]
    k = refs.languages.index(language)
    assert m["class_distance"][0] == pytest.approx(js(kinds / kinds.sum(), refs.classes[k]))
    tokens = [x.lower() for x in re.findall(r"[^\W\d_]+", text)]
    counts = np.array([tokens.count(w) for w in quality_rules.COMMON_WORDS[language].split()], dtype=float)
    assert m["word_distance"][0] == pytest.approx(js(np.append(counts, len(tokens) - counts.sum()) / len(tokens), refs.words[k]))


def test_quality_filter(spark, empty):
    rng = random.Random(4)
    common = quality_rules.COMMON_WORDS["en"].split()
    prose = " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(["wander", "hollow", "meadow", "carry", "simple", "window", "river"]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(400))
    rows = [(1, prose, "en", None, 0), (2, prose.upper().replace(" ", "!! "), "en", None, 0), (3, prose.replace(" ", "%%% "), None, None, 0), (4, None, None, None, 0), (None, prose, None, None, 0)]
    kept = quality_rules.filter_quality(clashing(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(((r.doc_id is None, r.doc_id, r.label) for r in kept.collect())) == [(False, 1, "x"), (True, None, "x")]
    assert quality_rules.filter_quality(empty).count() == quality_rules.score_quality(empty).count() == 0


# --- 2, 6 -----------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_equals_library(path):
    encoder, library = CachedEncoder(path, limit=50), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = [*"ab'sStŉǰ²ß \n\t.,1éñª½ÀŸ", "  ", "'re", " A", "\n\n", " '", "<|endoftext|>", "日", "́", "I'LL", "''s", "x'S"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)), *(r[1] for r in corpus() if r[1])]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_every_plain_sign_equals_library(path):
    encoder, library = CachedEncoder(path), tokenizers.Tokenizer.from_file(path)
    signs = [x for x in map(chr, range(0x250)) if PLAIN.fullmatch(x)]
    texts = [a + x + b for x in signs for a in ("", "a", "é", "1", "5 ", "-", ". ", "ab ") for b in ("", "m", "ß", "2", " m", "%", x)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def reference_ids(rows, path, end):
    library = tokenizers.Tokenizer.from_file(path)
    return [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_record_round_trip(spark, docs, empty, tmp_path):
    want = reference_ids(corpus(), BYTE, 2)
    got = sorted(record_files.encode_and_read(clashing(docs), BYTE).collect(), key=lambda r: r.start)
    order = lambda x: (x is not None, x or 0)
    assert [order(r.doc_id) for r in got] == sorted(order(i) for i, _ in want)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    pairs = collections.Counter((i, len(x), crc(x)) for i, x in want)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == pairs
    manifest = record_files.write_records(docs, BYTE, str(tmp_path / "w"), 2)
    shuffled = record_files.read_records(spark, manifest, str(tmp_path / "w"), shuffle_seed=7)
    rows = shuffled.collect()
    assert collections.Counter((r.doc_id, r.n_tokens, crc(r.ids)) for r in rows) == pairs and [r.record for r in rows if r.shard == 0] != sorted(r.record for r in rows if r.shard == 0)
    assert {(r.start, r.ids_crc32) for r in rows} == {(r.start, r.ids_crc32) for r in got}
    assert record_files.encode_and_read(empty, BYTE).count() == 0


def test_damage_is_found(spark, docs, tmp_path):
    manifest = record_files.write_records(docs, BYTE, str(tmp_path), 2)
    path = next(tmp_path.glob("*.rec"))
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        record_files.read_records(spark, manifest, str(tmp_path)).collect()


def test_packing(docs, empty):
    want = collections.defaultdict(list)
    for i, ids in reference_ids(corpus(), WORDS, 1):
        want[i].append(ids)
    rows = packing.pack(clashing(docs), WORDS, size=256).collect()
    sequences = collections.defaultdict(list)
    covered = collections.Counter()
    for r in rows:
        match = [x for x in want[r.doc_id] if len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32]
        assert match and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    assert covered == {i: sum(map(len, x)) for i, x in want.items()}
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and (total == 256 or total & (total - 1) == 0)
    assert packing.pack(empty, WORDS).count() == 0


def test_hilbert_curve_is_one_walk():
    n = 8
    points = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    keys = packing.hilbert_key(points, 3)
    walk = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(n**3)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# --- 3 --------------------------------------------------------------------


def repeated_words(rows, least=50):
    """Words of each document in a window of ``least`` words that another document has."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in words.items():
        hit = set()
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                hit |= set(range(k, k + least))
        out[i] = hit
    return out


def passages(seed, n=90):
    """Unlike documents, some with one of five passages of 50 words or more."""
    rng, words = random.Random(seed), vocabulary(seed, 3000)
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(k) for k in (50, 51, 64, 90, 300)]
    return [(i, " ".join([text(rng.randint(0, 90)), *([shared[i % 5]] if i % 3 == 0 else []), text(rng.randint(0, 90))]), "en", "s", 0) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = passages(seed)
    got = collections.defaultdict(set)
    spans = suffix_dedup.repeated_passages(clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    for r in spans:
        got[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    want = repeated_words([(r[0], r[1]) for r in rows])
    assert {i: got[i] for i in want} == want
    firsts = [min(i for i in range(90) if i % 3 == 0 and i % 5 == k) for k in range(5)]
    assert sorted({r.doc_id for r in spans if not r.copy} - {r.doc_id for r in spans if r.copy}) == sorted(firsts)


def hot_lines(seed, n=400):
    """Unlike documents of which most have a frequent line of 40 words, with different words after it; some have passages of
    25 own words, then the line."""
    rng, words = random.Random(seed), vocabulary(seed, 3000)
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    line, own = text(40), [text(25) for _ in range(12)]
    rows = [(i, f"{text(30)} {own[rng.randrange(12)] if i % 5 == 0 else text(25)} {line if i % 4 else text(40)} {text(30)}", "en", "s", 0) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_that_end_in_a_hot_line(spark, seed):
    rows = hot_lines(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {i: x for i, x in repeated_words([(r[0], r[1]) for r in rows]).items() if x}
    for n in (1, 7, 40):
        got = collections.defaultdict(set)
        for r in suffix_dedup.repeats(df, n).collect():
            got[r.doc] |= set(range(r.start, r.stop))
        assert dict(got) == want


def crowd(seed, pairs=12, each=32):
    """Pairs that share a passage of 55 words, amid documents that share 30 to 48 words of it with one of the two only."""
    rng, words = random.Random(seed), vocabulary(seed, 3000)
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for _ in range(pairs):
        passage = text(55).split()
        rows += [f"{text(30)} {' '.join(passage)} {text(30)}" for _ in range(2)]
        for _ in range(each):
            k = rng.randint(30, 48)
            part = passage[:k] if rng.random() < 0.5 else passage[-k:]
            rows.append(f"{text(rng.randint(5, 30))} {' '.join(part)} {text(rng.randint(5, 30))}")
    rng.shuffle(rows)
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("chunk", [40_000, 60])
def test_passages_whose_parts_are_quoted(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = crowd(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got = collections.defaultdict(set)
        for r in suffix_dedup.repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 2).collect():
            got[r.doc] |= set(range(r.start, r.stop))
        hot = collections.defaultdict(set)
        lines = hot_lines(5, 150)
        for r in suffix_dedup.repeats(spark.createDataFrame(lines, SCHEMA).repartition(3), 2).collect():
            hot[r.doc] |= set(range(r.start, r.stop))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert dict(got) == {i: x for i, x in repeated_words([(r[0], r[1]) for r in rows]).items() if x}
    assert dict(hot) == {i: x for i, x in repeated_words([(r[0], r[1]) for r in lines]).items() if x}


def test_rows_of_one_id_are_apart(spark):
    """Rows of one id with different texts are documents of their own; a repeated row is one document."""
    rng, words = random.Random(8), vocabulary(8, 2000)
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = text(80)
    a, b, c = f"{text(20)} {shared}", f"{shared} {text(120)}", text(300)
    rows = [(1, a), (1, b), (1, c), (2, a), (2, a), (3, "x"), (None, b), (None, None)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in suffix_dedup.remove_repeats(own_names(df)).collect() if r.text is not None)
    assert len(got) == 7 and ("1", c) in got and ("3", "x") in got
    assert sum(shared in t for _, t in got) == 1 and {("1", a), ("1", b)} & set(got)
    assert all(t.strip() in {"", " ".join(a.split()[:20]), " ".join(b.split()[80:])} for i, t in got if i in ("2", "None"))


@pytest.mark.parametrize("n", [1, 7])
def test_all_but_the_first_are_copies_before_a_hot_line(spark, n):
    rows = hot_lines(3, 200)
    earliest = {}
    for i, t, *_ in sorted(rows):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            earliest.setdefault(tuple(w[k : k + 50]), i)
    want = {True: collections.defaultdict(set), False: collections.defaultdict(set)}
    shared = {i: x for i, x in repeated_words([(r[0], r[1]) for r in rows]).items() if x}
    for i, t, *_ in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            if set(range(k, k + 50)) <= shared.get(i, set()):
                want[earliest[tuple(w[k : k + 50])] < i][i] |= set(range(k, k + 50))
    got = {True: collections.defaultdict(set), False: collections.defaultdict(set)}
    for r in suffix_dedup.repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), n).collect():
        got[r.copy][r.doc] |= set(range(r.start, r.stop))
    assert len(want[True]) > len(want[False]) > 0 and got == want


def test_copies_are_cut_and_first_stay(spark, empty):
    rows = passages(3)
    rows += [(200, rows[0][1], None, None, 0), (201, None, None, None, 0), (None, rows[1][1] * 2, None, None, 0), (202, "", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = {(r.doc_id, r.label): r.text for r in suffix_dedup.remove_repeats(clashing(df)).collect()}
    assert len(cut) == len(rows) and cut[(201, "x")] is None and cut[(200, "x")].strip() == "" and cut[(1, "x")] == rows[1][1]
    left = repeated_words([(i, t) for (i, _), t in cut.items()])
    assert not any(left.values())
    assert suffix_dedup.repeated_passages(empty).count() == suffix_dedup.remove_repeats(empty).count() == 0


def test_minimisers_hold_every_window():
    rng = np.random.default_rng(1)
    hashes, first = rng.integers(0, 50, 500).astype(np.uint64), np.array([0, 3, 3, 200, 500])
    kept = set(suffix_dedup.minimisers(hashes, first, 7).tolist())
    for a, b in zip(first, first[1:]):
        for k in range(a, b - 6):
            assert k + int(np.argmin(hashes[k : k + 7])) in kept
    assert not kept & {0, 1, 2}


# --- 4 --------------------------------------------------------------------


def lz_phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen, text[start:]


def test_phrases_equal_plain_parse():
    for text in ("", "a", "aaaaaa", "abracadabra abracadabra", "日本日本 éé"):
        seen = set()
        last = lz_fingerprint.parse(lz_fingerprint.codes_of(text), seen)
        want, rest = lz_phrases(text)
        assert len(seen) == len(want) and (last != 1) == bool(rest)


def test_fingerprints(docs, empty):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = lz_fingerprint.fingerprints(clashing(docs)).collect()
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in rows]
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    for k in range(3, len(rows)):  # the two rows without id and the repeated one have no fixed order
        text, following = texts[k], texts[(k + 1) % len(rows)]
        if k + 1 == len(rows) or rows[k][0] == 3:
            continue
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = (lz_fingerprint.fingerprint(x) for x in (text, edited, following))
        assert (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)) in by_id[rows[k][0]]
    assert lz_fingerprint.fingerprints(empty).count() == 0


# --- 5 --------------------------------------------------------------------


def brute_links(rows, k=5):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed, n=80):
    """A base and copies with few to many edits, some of which link only to each other; short texts; upper case."""
    rng, words = random.Random(seed), vocabulary(seed, 800)
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i * 3, " ".join(copy)))
    rows += [(1000 + i, " ".join(words[i : i + 4 + i % 3])) for i in range(12)]
    return rows + [(2000, "One two"), (2001, "one TWO"), (2002, "ÉA b"), (2003, "éa b"), (2004, None), (2005, "")]


@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in corpus(5)], near_copies(1), near_copies(2)])
def test_components_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA).repartition(3)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(clashing(df)).collect()), key=key)
    assert got == sorted(brute_links(rows), key=key)


def test_frequent_tokens_dont_change_links(spark):
    rows = near_copies(4)
    df = spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA)
    want = sorted(brute_links(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(df, heavy=1).collect()) == want


@pytest.mark.parametrize("seed", [1, 7])
def test_split_groups_lose_no_links(spark, monkeypatch, seed):
    """Groups of every min-hash and token are split; unlike documents that share a line meet across blocks."""
    monkeypatch.setattr(ngram_join, "HOT_STAR", 3)
    monkeypatch.setattr(ngram_join, "HOT_TOKEN", 4)
    monkeypatch.setattr(ngram_join, "ALIKE", 0.99)  # so the prefix join has much to do
    rows, words = near_copies(seed), vocabulary(seed, 300)
    rows += [(3000 + i, " ".join(words[:60] + words[60 + i % 20 : 64 + i % 20])) for i in range(40)]
    df = spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA).repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(df).collect()) == sorted(brute_links(rows))


def test_marks_pass_all_links():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(1, 1 << 60, 200).astype(np.uint64))
    for orders in (1, 3):
        for gone in range(0, 60, 3):
            other = np.sort(base[rng.permutation(len(base))[gone:]])
            values, bounds = np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])
            x, y = ngram_join.prefix_marks(values, bounds, ngram_join.Frequent(base[:5]), orders)
            if ngram_join.reaches(base, other, 80):
                assert ngram_join.shares_all(x, y, orders)
    x, y = ngram_join.prefix_marks(np.arange(1, 401, dtype=np.uint64), np.array([0, 200, 400]), ngram_join.Frequent(base[:0]), 3)
    assert not ngram_join.shares_all(x, y, 3)


def test_keep_one(spark, empty):
    rows = near_copies(3)
    kept = ngram_join.keep_one(clashing(spark.createDataFrame([(*r, None, None, 0) for r in rows], SCHEMA)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute_links(rows) if d == c)
    assert ngram_join.link(empty).count() == ngram_join.keep_one(empty).count() == 0


def test_keep_one_decides_by_row(spark):
    words = vocabulary(6, 300)
    a, b, c, d, e = (" ".join(words[k : k + 40]) for k in range(0, 200, 40))
    rows = [(1, a)] * 5 + [(None, a), (None, None), (None, " "), (None, b), (None, b)]  # copies under one id; null ids
    rows += [(2, c), (7, d), (7, c)]  # one id, two texts, of which one is a copy of a lesser id's
    rows += [(8, e), (8, f"{e} {a}")]  # both alone
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).repartition(3)
    got = ngram_join.keep_one(own_names(df))
    assert got.columns == own_names(df).columns
    want = [(1, a), (None, None), (None, " "), (None, b), (2, c), (7, d), (8, e), (8, f"{e} {a}")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_large_key_tables_are_shuffled(spark, docs, monkeypatch):
    from fileloom.llm import common

    key = lambda r: (str(r.doc_id), str(r.text))
    small = sorted(map(key, ngram_join.keep_one(docs).collect())), sorted(map(key, mixing.take_mix(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert small == (sorted(map(key, ngram_join.keep_one(docs).collect())), sorted(map(key, mixing.take_mix(docs).collect())))


# --- 7 --------------------------------------------------------------------


def smallest_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, fill = (lo + hi) // 2, 1, 0
        for x in sizes:
            if fill + x > mid:
                used, fill = used + 1, 0
            fill += x
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(docs, shards):
    rows = sharding.shard(clashing(docs), shards).collect()
    texts = collections.defaultdict(list)
    for r in corpus():
        texts[r[1]].append(r)
    assert len(rows) == len(corpus())
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(texts, key=lambda t: "null" if t is None else hashlib.md5(t.encode()).hexdigest())
    assert max(collections.Counter({s: sum(r["size"] for r in rows if r.shard == s) for s in range(shards)}).values()) == smallest_capacity([size(t) * len(texts[t]) for t in order], shards)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    where = {r[0]: r[1] for r in corpus() if r[0] is not None}
    found = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            assert r["size"] == size(where[r.doc_id]) and r.text_crc32 == zlib.crc32((where[r.doc_id] or "").encode()) and r.law == "bytes"
            found[where[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in found.values())


@pytest.mark.parametrize("near_rows", [100_000, 3])
def test_cuts_are_the_same_either_way(spark, monkeypatch, near_rows):
    """With the ends near the cuts in the driver, or a job for each question."""
    monkeypatch.setattr(sharding, "NEAR_ROWS", near_rows)
    rng = random.Random(11)
    rows = [(i, "x" * rng.randint(0, 40) + str(i % 700), None, None, 0) for i in range(1500)]
    df = spark.createDataFrame(rows + [(None, "same", None, None, 0)] * 30, SCHEMA).repartition(4)
    got = sharding.shard(df, 5).collect()
    groups = collections.Counter()
    for r in rows + [(None, "same")] * 30:
        groups[r[1]] += len(r[1]) + 1
    order = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert max(sums.values()) == smallest_capacity([groups[t] for t in order], 5) and len(got) == 1530
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(5))


def test_sharding_plan_is_native(docs, empty):
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and sharding.shard(empty).count() == 0


# --- 9 --------------------------------------------------------------------


def test_targets_by_hand():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    got = mixing.targets([("a", 10), ("b", 1000), ("c", 500), ("d", 0)])
    assert got["a"] == 20 and got["d"] == 0 and sum(got.values()) == pytest.approx(1.5 * 1510)
    assert mixing.targets([]) == {}


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    p, x = np.full(300, 0.37), rng.integers(1, 500, 300)
    out = mixing.flight(p, x, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(p.sum()) and (out * x).sum() == pytest.approx((p * x).sum())
    mean = np.mean([mixing.flight(p[:12], x[:12], np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.05  # inclusion probabilities hold


def test_mix(spark, docs, empty):
    a = mixing.mix(clashing(docs), block=16).collect()
    b = mixing.mix(docs.repartition(2), block=16).collect()
    key = lambda r: (str(r.doc_id), r.digest, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(corpus())
    sizes = collections.Counter()
    for r in corpus():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = mixing.targets(list(sizes.items())), collections.Counter()
    for r in a:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 10 for s in sizes if sizes[s] > 500)
    rows = mixing.take_mix(clashing(docs)).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in rows) == pytest.approx(sum(want.values()), rel=0.1) and rows[0].label == "x"
    assert mixing.mix(empty).count() == mixing.take_mix(empty).count() == 0
    again = mixing.take_mix(own_names(docs))
    assert again.columns == own_names(docs).columns and sorted(str(r.doc_id) for r in again.collect()) == sorted(str(r.doc_id) for r in rows)


# --- 1, 10 ----------------------------------------------------------------


def marked(seed, n=700):
    rng, words = random.Random(seed), vocabulary(seed, 300)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 1
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(4 * bad):
            w[rng.randrange(len(w))] = rng.choice(["qwyx", "zokkor", "hujjik"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out(spark, empty):
    rows, labels = marked(1)
    odd = [(9000, None, None, None, 0), (9001, "", None, None, 0), (None, "x", None, None, 0), rows[0]]
    df = clashing(spark.createDataFrame(rows + odd, SCHEMA))
    known = spark.createDataFrame(labels + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(df, known).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in want and r.held_out]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 50 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert [r.score for r in toxicity.score_toxicity(df, known.limit(0)).collect()] == [0.0] * len(got)
    assert toxicity.score_toxicity(empty, known).count() == 0


def test_dictionaries_are_trained_apart():
    rows, labels = marked(2, 900)
    toxic, ordinary = ([r[1] for r, x in zip(rows, labels) if x[2] == y] for y in (1, 0))
    model = toxicity.fit(toxic, ordinary)
    assert len(model.toxic) == len(model.ordinary) and not model.toxic.endswith(model.ordinary)
    assert all(w in model.toxic and w not in model.ordinary for w in (b"qwyx", b"zokkor", b"hujjik"))
    # counted sequences equal a plain count
    keys, counts = toxicity.spread_of(toxic, 5)
    plain = collections.Counter(d for x in toxic for d in {f" {' '.join(WORD.findall(x.lower()))} ".encode()[k:][:6] for k in range(len(f" {x} ".encode()) - 5)})
    assert dict(zip(keys.tolist(), counts.tolist())) == {int.from_bytes(d, "big"): n for d, n in plain.items() if n >= 5}


def test_labels_that_repeat_or_disagree(spark):
    rows, labels = marked(3, 500)
    df = spark.createDataFrame(rows, SCHEMA)
    doubled = spark.createDataFrame(labels + labels[:50] + [(i, 1, 0) for i, _, t in labels if t], "doc_id int, quality int, toxic int")
    once = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(x, y).collect()) for x, y in ((df, once), (df.withColumn("doc_id", df.doc_id.cast("int")).repartition(5), doubled)))
    assert a == b


def tongues(seed, n=240):
    rng = random.Random(seed)
    words = {"aa": vocabulary(11, 150), "bb": ["".join(rng.choice("rstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(150)]}
    return words, [(i, " ".join(rng.choice(words[("aa", "bb")[i % 2]]) for _ in range(rng.randint(3, 60))) + " 12.", ("aa", "bb")[i % 2], "s", 0) for i in range(n)]


def test_languages_on_held_out(spark, empty):
    _, rows = tongues(1)
    odd = [(9000, None, "aa", None, 0), (9001, "12 -- 3", "aa", None, 0), (9002, "", None, None, 0), (None, "rst uvw", None, None, 0)]
    got = {r.doc_id: r for r in language_crf.label_languages(clashing(spark.createDataFrame(rows + odd, SCHEMA))).collect()}
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if got[r[0]].held_out]) > 0.97
    assert language_crf.label_languages(empty).count() == 0
    assert {r.lang_pred for r in language_crf.label_languages(spark.createDataFrame([(1, "abc", None, None, 0)], SCHEMA)).collect()} == {"und"}


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    e, t = np.exp(rng.normal(size=(5, 3))), rng.normal(size=(3, 3))
    weight = collections.defaultdict(float)
    for path in itertools.product(range(3), repeat=5):
        w = np.prod([e[k, y] for k, y in enumerate(path)]) * np.exp(sum(t[a, b] for a, b in zip(path, path[1:])))
        w *= np.exp(t[:, path[0]]).sum()  # any label before the first word
        for k, y in enumerate(path):
            weight[k, y] += w
    want = np.array([[weight[k, y] for y in range(3)] for k in range(5)])
    want /= want.sum(1, keepdims=True)
    for stretch in (1, 2, 3, 48):
        assert np.allclose(language_crf.marginals(e, np.array([5]), t, stretch), want)


def test_spans_of_switched_texts(spark, empty):
    words, rows = tongues(3)
    text = " ".join(words["aa"][:20]) + ". 12 " + " ".join(words["bb"][:20])
    df = clashing(spark.createDataFrame(rows + [(7000, text, None, None, 0), (7001, "12", None, None, 0), (None, None, None, None, 0)], SCHEMA))
    got = sorted((r.start_word, r.n_words, r.lang) for r in language_crf.label_spans(df).filter("doc_id = 7000").collect())
    assert sum(n for _, n, _ in got) == 40 and [s for s, _, _ in got] == np.cumsum([0, *(n for _, n, _ in got)])[:-1].tolist()
    labels = [lang for _, n, lang in got for _ in range(n)]
    assert (np.array(labels) == np.array(["aa"] * 20 + ["bb"] * 20)).mean() > 0.9
    assert language_crf.label_spans(df).filter("doc_id = 7001 or doc_id is null").count() == language_crf.label_spans(empty).count() == 0


def test_code_switching_follows_neighbours():
    words, rows = tongues(2)
    crf = language_crf.train([(r[1], r[2]) for r in rows])
    text = words["aa"][:15] + words["bb"][:15]
    p = language_crf.marginals(np.exp(crf.emissions(text)), np.array([30]), crf.transitions)
    assert (p.argmax(1) == [0] * 15 + [1] * 15).mean() > 0.9


# --- SQL ------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op5_ngram_join", "op8_quality"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from fileloom.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(found.fetchall())


# --- pipeline -------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    common = quality_rules.COMMON_WORDS["en"].split()
    words = ["".join(rng.choice(["ta", "lo", "mer", "in", "sha", "ve"]) for _ in range(rng.randint(2, 4))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    passage = prose(80)
    rows = [(i, f"{prose(150)} {passage if i % 4 == 0 else ''} {prose(60)}", "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, rows[1][1], "en", "s0", 0), (101, "short", "en", "s0", 0), (102, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packed":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == list(range(30))
    assert sum(passage in r.text for r in seen["repeated_passages"]) == 1 and all(r.n_chars == len(r.text) for r in seen["repeated_passages"])
    assert {r.doc_id for r in seen["packed"]} == {r.doc_id for r in seen["mixed"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packed"])


def test_pipeline_of_empty_tables_and_extra_columns(spark, tmp_path, empty):
    import corpus_pipeline

    rng = random.Random(3)
    common = quality_rules.COMMON_WORDS["en"].split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(["wander", "hollow", "meadow", "carry", "river"]) + rng.choice(["", "s", "ed", "ing"]) + rng.choice("abc") for _ in range(n))
    rows = [(i, prose(120), "en", "s1", 0) for i in range(12)] + [(None, prose(100), "en", None, 0), (5, prose(90), None, "s1", None)]
    for name, docs in (("empty", own_names(empty)), ("extra", own_names(clashing(spark.createDataFrame(rows, SCHEMA))))):
        (tmp_path / name).mkdir()
        for stage, f in corpus_pipeline.STAGES:
            before = docs.columns
            f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            assert stage == "packed" or docs.columns == before
            assert (docs.count() == 0) == (name == "empty")


# --- long texts, narrow ids --------------------------------------------------


def test_long_texts_and_narrow_ids(spark):
    """A text of more than a megabyte, its copy and its near copy, among short ones; ids are 32 bits wide."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    words = vocabulary(12, 5000)
    long = " ".join(rng.choice(words) for _ in range(200_000))
    near = cut = long.split()
    distinct = len({tuple(cut[k : k + 5]) for k in range(199_996)})
    near[100_000] = "changed"
    near = " ".join(near)
    rows = [(1, long, "aa", "s1", 0), (2, long, "aa", "s1", 0), (3, near, "aa", "s2", 0), (4, "short text", "aa", "s2", 0), (5, None, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("int")).repartition(2)
    assert len(long) > 1 << 20
    by_id = lambda found: {r.doc_id: r for r in found.collect()}
    links = by_id(ngram_join.link(df))
    assert {i: links[i].component_id for i in links} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} and links[1].n_shingles == distinct
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [1, 4, 5]
    spans = sorted((r.doc_id, r.start_word, r.n_words, r.copy) for r in suffix_dedup.repeated_passages(df).collect())
    assert spans == [(1, 0, 200_000, False), (2, 0, 200_000, True), (3, 0, 100_000, True), (3, 100_001, 99_999, True)]
    want = dict(reference_ids(rows, BYTE, 2))
    records = by_id(record_files.encode_and_read(df, BYTE))
    assert {i: (r.n_tokens, r.ids_crc32) for i, r in records.items()} == {i: (len(x), crc(x)) for i, x in want.items()}
    packed = collections.Counter()
    for r in packing.pack(df, WORDS).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(x) for i, x in reference_ids(rows, WORDS, 1)}
    marks = by_id(lz_fingerprint.fingerprints(df))
    assert marks[1].fingerprint == marks[2].fingerprint and marks[1].n_chars == len(long) and marks[2].near_next > 0.9
    placed = by_id(sharding.shard(df, 2))
    assert placed[1]["size"] == len(long.encode()) + 1 and placed[1].shard == placed[2].shard
    scored = by_id(quality_rules.score_quality(df))
    assert scored[1].n_words == 200_000 and scored[1].word_chars == sum(map(len, long.split()))
    mixed = by_id(mixing.mix(df))
    assert mixed[1]["size"] == 200_000 and mixed[5].taken == 0
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 6)], "doc_id int, quality int, toxic int")
    assert sorted(by_id(toxicity.score_toxicity(df, labels))) == sorted(by_id(language_crf.label_languages(df))) == [1, 2, 3, 4, 5]
    assert by_id(language_crf.label_languages(df))[1].lang_pred == "aa"

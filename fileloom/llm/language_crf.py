"""Language identification by a linear-chain conditional random field.

Each word of a text is a node; its features are the word itself (lexicon), its beginnings and endings of one to three
bytes, and its trigrams, hashed to ``BUCKETS`` weights per language. Learned transitions join neighbouring words, so
that a word that could be of two languages follows its neighbours, also in text that changes language midway.
Forward-backward gives each word's label probabilities; a document's language is the one with the most expected words, its
score that language's share.

Inference is exact on whole texts and vectorised over all words of a block: texts are cut into stretches of
``STRETCH`` words, the transfer matrix of every stretch is built at once, stretches are joined per document, and a second pass
gives the marginals. Scores of distinct words are kept per worker in a cache of bounded size.

Training uses at most about ``sample`` documents per language with the least hash of their id, never from the held-out fold,
and of each at most ``TRAIN_WORDS`` words; half of the training sequences join stretches of different documents, so
transitions between languages are seen.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned;
every row gives a row, repeated rows the same; of labels that disagree for one id all are learned from; texts of any length are
labelled whole; an empty table gives an empty result; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import batch_slices, held_out, text_column
from fileloom.llm.wordblocks import Block, mix, spread

BUCKETS = 1 << 15
SAMPLE, TRAIN_WORDS, SEQUENCE = 400, 160, 32
STRETCH = 48
EPOCHS, RATE, DECAY = 12, 0.35, 1e-6
CACHE = 120_000
PLAIN, MARKED = re.compile(r"[^\W\d_]+"), regex.compile(r"[\p{L}\p{M}]+")
BEYOND_LATIN = re.compile("[\u0300-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and marks."""
    return (MARKED if BEYOND_LATIN.search(text) else PLAIN).findall(text)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, word by word, and how many each has.

    Beginnings, endings and n-grams are of UTF-8 bytes; case doesn't count.
    """
    raw = [f"<{w.lower()}>".encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(raw) + b"\0\0\0", dtype=np.uint8).astype(np.uint64)
    one, two, three = data[:-3], data[:-3] | data[1:-2] << np.uint64(8), data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16)
    grams = sizes - 2
    owner = [spread(grams)]
    value = [three[np.arange(grams.sum()) + np.repeat(starts - (np.cumsum(grams) - grams), grams)] << np.uint64(3)]
    for k, code in ((1, one), (2, two), (3, three)):
        some = np.flatnonzero(grams >= k)
        owner += [some, some]
        value += [code[starts[some] + 1] << np.uint64(3) | np.uint64(k), code[ends[some] - 1 - k] << np.uint64(3) | np.uint64(k + 3)]
    block = Block(data[:-3].astype(np.uint8), np.append(starts, ends[-1:] if len(ends) else [0]), np.ones(len(raw), dtype=bool))
    owner.append(np.arange(len(raw)))
    value.append(block.hashes(starts, ends) << np.uint64(3) | np.uint64(7))
    owner, value = np.concatenate(owner), np.concatenate(value)
    value = value[np.argsort(owner, kind="stable")]
    return (mix(value) & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(owner, minlength=len(raw))


class Crf:
    """Languages, feature weights (bucket, language) and transitions (from, to)."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights.astype(np.float32), transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language, less the greatest."""
        flat, counts = features(words)
        out = np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts, axis=0).astype(np.float64) / np.sqrt(counts)[:, None]
        return out - out.max(1, keepdims=True)


def marginals(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """Label probabilities of each word. ``e``: exp(emission) of all words, texts one after the other, ``lengths`` > 0."""
    n, k = e.shape
    t = np.exp(transitions - transitions.max())
    pieces = -(-lengths // stretch)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    total = int(pieces.sum())
    text = np.repeat(np.arange(len(lengths)), pieces)
    order = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[text] + order * stretch
    size = np.minimum(stretch, lengths[text] - order * stretch)
    # Words of all stretches side by side; a short stretch is filled up and left out by ``on``.
    at = start[:, None] + np.arange(stretch)
    on = np.arange(stretch) < size[:, None]
    grid = np.where(on[:, :, None], e[np.minimum(at, n - 1)], 1.0)
    # Transfer matrix of each stretch: from the label before it to that of its last word.
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(stretch):
        live = on[:, j]
        step = (m[live].reshape(-1, k) @ t).reshape(-1, k, k) * grid[live, j][:, None, :]
        m[live] = step / step.sum((1, 2), keepdims=True)
    # Into each stretch, from the left and from the right, document by document.
    left, right = np.full((total, k), 1.0 / k), np.full((total, k), 1.0)
    first = np.cumsum(pieces) - pieces
    for depth in range(1, int(pieces.max())):
        rows = first[pieces > depth] + depth
        out = np.einsum("ni,nij->nj", left[rows - 1], m[rows - 1])
        left[rows] = out / out.sum(1, keepdims=True)
    for depth in range(int(pieces.max()) - 2, -1, -1):
        rows = first[pieces > depth + 1] + depth
        out = np.einsum("nij,nj->ni", m[rows + 1], right[rows + 1])
        right[rows] = out / out.sum(1, keepdims=True)
    forward = np.empty_like(grid)
    a = left
    for j in range(stretch):
        a = (a @ t) * grid[:, j]
        a /= a.sum(1, keepdims=True)
        forward[:, j] = a
    out = np.empty_like(grid)
    b = right.copy()
    for j in range(stretch - 1, -1, -1):
        live = on[:, j]
        p = forward[live, j] * b[live]
        out[live, j] = p / p.sum(1, keepdims=True)
        back = (b[live] * grid[live, j]) @ t.T
        b[live] = back / back.sum(1, keepdims=True)
    return out[on]


def train(rows: list[tuple[str, str]], seed: int = 5) -> Crf | None:
    """A field from (text, language) pairs: likelihood ascent with per-weight rates over batches of sequences."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    code = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    stretches: list[tuple[list[str], int]] = []
    for text, lang in rows:
        words = words_of(text)[:TRAIN_WORDS]
        stretches += [(words[i : i + SEQUENCE], code[lang]) for i in range(0, len(words), SEQUENCE)]
    k = len(languages)
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    if not stretches:
        return Crf(languages, weights, trans)
    sequences = [(w, [y] * len(w)) for w, y in stretches]
    for i in rng.permutation(len(stretches))[: len(stretches) // 2]:  # code-switched sequences
        other, y = stretches[int(rng.integers(len(stretches)))], stretches[i]
        cut = int(rng.integers(1, SEQUENCE))
        a, b = y[0][:cut], other[0][: SEQUENCE - cut]
        sequences.append((a + b, [y[1]] * len(a) + [other[1]] * len(b)))
    vocabulary = sorted({w for s, _ in sequences for w in s})
    index = {w: i for i, w in enumerate(vocabulary)}
    flat, sizes = features(vocabulary)
    begin = np.cumsum(sizes) - sizes
    data = [(np.array([index[w] for w in s]), np.array(y)) for s, y in sequences if s]
    gw, gt = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1e-3)
    batch = 256
    for _ in range(EPOCHS):
        for lo_hi in np.array_split(rng.permutation(len(data)), max(1, len(data) // batch)):
            ids = np.concatenate([data[i][0] for i in lo_hi])
            y = np.concatenate([data[i][1] for i in lo_hi])
            lengths = np.array([len(data[i][0]) for i in lo_hi])
            n = sizes[ids]
            at = np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            feature, owner = flat[at], np.repeat(np.arange(len(ids)), n)
            scale = 1 / np.sqrt(n)
            emission = np.add.reduceat(weights[feature], np.cumsum(n) - n, axis=0) * scale[:, None]
            e = np.exp(emission - emission.max(1, keepdims=True))
            p, pair = _expectations(e, lengths, trans)
            gap = -p * scale[:, None]
            gap[np.arange(len(y)), y] += scale
            for label in range(k):
                g = np.bincount(feature, gap[owner, label], minlength=BUCKETS) / len(lo_hi) - DECAY * weights[:, label]
                gw[:, label] += g * g
                weights[:, label] += RATE * g / np.sqrt(gw[:, label])
            inner = np.ones(len(y), dtype=bool)
            inner[np.cumsum(lengths) - 1] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][inner[:-1]], y[1:][inner[:-1]]), 1)
            g = (seen - pair) / len(lo_hi) - 1e-3 * trans
            gt += g * g
            trans += RATE * g / np.sqrt(gt)
    return Crf(languages, weights, trans)


def _expectations(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals, and the expected number of each pair of neighbouring labels, by forward-backward."""
    t = np.exp(trans - trans.max())
    k, longest, begin = e.shape[1], int(lengths.max()), np.cumsum(lengths) - lengths
    at = np.minimum(begin[:, None] + np.arange(longest), len(e) - 1)
    on = np.arange(longest) < lengths[:, None]
    grid = np.where(on[:, :, None], e[at], 1.0)
    f, b = np.empty_like(grid), np.ones_like(grid)
    a = np.full((len(lengths), k), 1.0 / k) @ t * grid[:, 0]
    f[:, 0] = a / a.sum(1, keepdims=True)
    for j in range(1, longest):
        a = (f[:, j - 1] @ t) * grid[:, j]
        f[:, j] = a / a.sum(1, keepdims=True)
    pair = np.zeros((k, k))
    for j in range(longest - 2, -1, -1):
        live = on[:, j + 1]
        ahead = grid[:, j + 1] * b[:, j + 1]
        back = ahead @ t.T
        b[:, j] = np.where(live[:, None], back / back.sum(1, keepdims=True), 1.0)
        joint = f[:, j][live][:, :, None] * t[None] * ahead[live][:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    p = (f * b)[on]
    return p / p.sum(1, keepdims=True), pair


class Scorer:
    """A worker's copy of the field, with the scores of words seen."""

    def __init__(self, crf: Crf):
        self.crf, self.known = crf, {}
        self.table = np.zeros((0, len(crf.languages)))

    def marginals(self, words: list[list[str]]) -> np.ndarray:
        """Label probabilities of all words, text after text; there is at least one."""
        distinct = set().union(*words)
        new = distinct.difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known, self.table, new = {}, self.table[:0], distinct
            new = list(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.exp(self.crf.emissions(new))])
        get, lengths = self.known.__getitem__, np.array([len(x) for x in words if x], dtype=np.int64)
        ids = np.fromiter((k for x in words for k in map(get, x)), dtype=np.int64, count=int(lengths.sum()))
        return marginals(self.table[ids], lengths, self.crf.transitions)

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, str, float]]:
        """(text, first word, words, language, mean probability) of runs of words of one language."""
        words = [words_of(x) for x in texts]
        if not any(words):
            return []
        p = self.marginals(words)
        label, owner = p.argmax(1), spread(np.array([len(x) for x in words], dtype=np.int64))
        first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])]))
        size = np.diff(np.append(first, len(label)))
        mean = np.add.reduceat(p.max(1), first) / size
        begin = np.searchsorted(owner, owner[first])
        return [(int(owner[a]), int(a - b), int(n), self.crf.languages[label[a]], min(1.0, float(s))) for a, b, n, s in zip(first, begin, size, mean, strict=True)]

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        crf = self.crf
        words = [words_of(x) for x in texts]
        lengths = np.array([len(x) for x in words], dtype=np.int64)
        label, score = ["und"] * len(texts), np.zeros(len(texts))
        if not lengths.sum():
            return label, score
        p, rows = self.marginals(words), np.flatnonzero(lengths)
        share = np.add.reduceat(p, np.cumsum(lengths[rows]) - lengths[rows], axis=0) / lengths[rows][:, None]
        best = share.argmax(1)
        for i, k, s in zip(rows.tolist(), best.tolist(), share.max(1).tolist(), strict=True):
            label[i], score[i] = crf.languages[k], min(1.0, s)
        return label, score


def _sample(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(text, lang) of at most about ``sample`` documents of each language outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r.lang, min(1.0, sample / r["count"])).otherwise(rate)
    words = F.array_join(F.slice(F.split("text", " "), 1, TRAIN_WORDS), " ").alias("text")
    chosen = known.filter(F.col("text").isNotNull() & (place <= rate)).select("doc_id", words, "lang", place.alias("place"))
    found = chosen.orderBy("place", "doc_id", "lang", "text").limit(2 * sample * len(counts)).collect()  # rows that tie are equal
    return [(r.text, r.lang) for r in sorted(found, key=lambda r: (r.doc_id, r.lang, r.text))]


def label_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, start_word, n_words, lang, score of each run of words of one language: where a text switches, and to what.

    Words are maximal runs of letters, counted from 0. Texts without letters, or where nothing could be learned, give no row.
    """
    crf = train(_sample(docs, sample))
    names = ["doc_id", "start_word", "n_words", "lang", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(crf) if crf is not None else None
        for batch in batch_slices(batches):
            found = scorer.spans([x or "" for x in text_column(batch).to_pylist()]) if scorer is not None else []
            if found:
                text, *columns = zip(*found, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start_word long, n_words long, lang string, score double")


def label_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    crf = train(_sample(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(crf) if crf is not None else None
        for batch in batch_slices(batches, limit=1 << 20):
            texts = [x or "" for x in text_column(batch).to_pylist()]
            label, score = scorer(texts) if scorer is not None else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

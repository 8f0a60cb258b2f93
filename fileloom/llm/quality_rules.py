"""Quality rules by distribution divergence.

Each text's character-class histogram and common-word histogram are compared to those of several languages by the
Jensen-Shannon distance (base 2, so from 0 to 1). The language whose two distances have the least sum counts; the
text is rejected if either distance exceeds its limit. Below ``min_letters`` letters or ``min_tokens`` letter runs
a histogram says too little and that test is passed over; texts of under 50 words or with more than half of their
words in repeated 3-word windows fail before (``base_failed``).

Everything is counted in one pass over a document's bytes, with no shuffle; a text is never cut.

The references are rounded shares of edited prose, stated below and not measured from the data at hand. :func:`measured`
makes references from a bounded sample of labelled documents instead. The limits leave room for prose with twice the punctuation
or half the common words.

Defined results: a null text counts as empty (no words: base_failed). A text with more than half of its letters beyond the
Latin script (Greek, Cyrillic, Chinese ...) has no reference: ``closest`` is ``und``, both tests are passed over and the base rules
alone decide. A text in Latin script in a language without a reference is compared to the closest one, and is rejected if it
uses too few of its common words. Texts of any length are counted whole. Rows are kept as they come: repeated rows,
null ids and extra columns pass through :func:`filter_quality`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import batch_slices, text_column
from fileloom.llm.wordblocks import Block, order_by, spread, windows

# Shares of character classes in edited prose, by language: lower-case a-z, letters beyond ASCII,
# upper-case A-Z, digits, white space, sentence punctuation, everything else.
CLASS_SHARES = {
    "de": (0.795, 0.020, 0.014, 0.002, 0.150, 0.018, 0.001),
    "en": (0.795, 0.001, 0.014, 0.002, 0.168, 0.019, 0.001),
    "es": (0.775, 0.028, 0.013, 0.002, 0.162, 0.019, 0.001),
    "fr": (0.755, 0.040, 0.014, 0.002, 0.168, 0.020, 0.001),
}
# The twenty most common words of each language, most frequent first.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein als eine",
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec",
}
#: Share of the most common word, and how the shares fall with the rank: share / (rank ** fall).
TOP_SHARE, SHARE_FALL = 0.062, 0.87

#: A text is rejected beyond these distances.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.345
MIN_LETTERS, MIN_TOKENS = 200, 50

CLASSES = 7
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
CLASS = np.full(256, 6, dtype=np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 2, 3
CLASS[[0x20, 9, 10, 11, 12, 13]] = 4
CLASS[list(b".,;:!?'\"()-")] = 5
CLASS[0xC3:0xE0] = 1  # lead bytes of two-byte letters; U+0080-U+00BF are signs
CLASS[0xE0:0xF0] = 1
CLASS[0xE2] = 6  # U+2000-U+2FFF: quotes, dashes and other signs
CLASS[0x80:0xC0] = 7  # continuation bytes: no character of their own
FAR = np.zeros(256, dtype=bool)  # lead bytes of letters from U+0340: other scripts
FAR[0xCD:0xF0] = True
FAR[0xE2] = False
LOWER_ASCII = {k: k + 32 for k in range(65, 91)}
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[65:91] = True
LETTER[0x80:] = True


def _hash_words(words: list[str]) -> np.ndarray:
    block = Block.of(pa.array(words, pa.string()))
    return block.hashes(block.offsets[:-1], block.offsets[1:], lower=True)


class References:
    """Histograms by language, and the words that are counted."""

    def __init__(self, class_shares: dict[str, tuple[float, ...]] | None = None, common_words: dict[str, str] | None = None, word_shares: dict[str, list[float]] | None = None):
        """``word_shares``: of the common words, in their order; a falling share by rank where none are given."""
        class_shares, common_words = class_shares or CLASS_SHARES, common_words or COMMON_WORDS
        self.languages = sorted(class_shares)
        shares = np.array([class_shares[x] for x in self.languages])
        self.classes = shares / shares.sum(1, keepdims=True)
        listed = sorted({w for x in self.languages for w in common_words[x].split()})
        hashes = _hash_words(listed)
        order = np.argsort(hashes)
        self.hashes, at = hashes[order], {listed[k]: i for i, k in enumerate(order)}
        self.columns, self.words = [], []
        for x in self.languages:
            own = common_words[x].split()
            share = TOP_SHARE / np.arange(1, len(own) + 1) ** SHARE_FALL if word_shares is None else np.array(word_shares[x])
            self.columns.append(np.array([at[w] for w in own]))
            self.words.append(np.append(share, 1 - share.sum()))


#: Documents of a language that references are measured on.
SAMPLE = 400
RUN = re.compile("[a-zA-Z\x80-\U0010ffff]+")


def measured(docs: DataFrame, sample: int = SAMPLE, words: int = 20) -> References:
    """References made from ``docs`` (doc_id, text, lang): of each language at most about ``sample`` documents with the least hash
    of their id, without those that the base rules reject.

    The sample comes to the driver, whole texts of a fixed number of documents. Null ids, texts and languages are left out; languages
    without a document that passes the base rules have no reference; without any the stated references are given.
    """
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    counts = known.groupBy("lang").count().collect()  # one row per language
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], min(1.0, sample / r["count"])).otherwise(rate)
    chosen = known.withColumn("place", place).filter(F.col("place") <= rate)
    found = chosen.orderBy("place", "doc_id", "lang", "text").limit(2 * sample * max(1, len(counts))).collect()
    plain = References()
    shares, listed, weights = {}, {}, {}
    for lang in sorted({r.lang for r in found}):
        texts = [r.text for r in found if r.lang == lang]
        good = ~measure(pa.array(texts, pa.string()), plain)["base_failed"]
        texts = [x for x, ok in zip(texts, good.tolist(), strict=True) if ok]
        if not texts:
            continue
        data = np.frombuffer("".join(texts).encode("utf-8", "replace"), dtype=np.uint8)
        classes = np.bincount(CLASS[data], minlength=CLASSES + 1)[:CLASSES]
        tokens = Counter(w for x in texts for w in RUN.findall(x.translate(LOWER_ASCII)))
        total = sum(tokens.values())
        top = sorted(tokens.items(), key=lambda t: (-t[1], t[0]))[:words]
        if not total:
            continue
        shares[lang], listed[lang] = tuple((classes / classes.sum()).tolist()), " ".join(w for w, _ in top)
        weights[lang] = [n / total for _, n in top]
    return References(shares, listed, weights) if shares else plain


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``, base 2; rows without mass have distance 1."""
    total = p.sum(1, keepdims=True)
    p = p / np.where(total == 0, 1, total)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] == 0, 1.0, np.sqrt(np.clip((left + right) / 2, 0, 1)))


def _distinct(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each owner."""
    if not len(owner):
        return np.zeros(rows, dtype=np.int64)
    order = order_by(owner, value)
    o, v = owner[order], value[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[fresh], minlength=rows)


def measure(column: pa.Array, refs: References) -> dict[str, np.ndarray]:
    """All counts and distances of a block of texts."""
    block = Block.of(column)
    n, data = len(block), block.data
    starts, ends, first = block.words()
    counts = np.diff(first)
    out = {"n_words": counts}

    char = (data & 0xC0) != 0x80
    kind = CLASS[data]
    out["word_chars"] = block.sums(char & (kind != 4))
    out["n_symbols"] = block.sums(SYMBOL[data])

    hashes = block.hashes(starts, ends)
    tri, at, begin = windows(hashes, first, 3)
    owner = spread(np.diff(begin))
    order = order_by(owner, tri)
    o, v = owner[order], tri[order]
    same = np.zeros(len(o) + 1, dtype=bool)
    same[1:-1] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(o), dtype=bool)
    twice[order] = same[:-1] | same[1:]
    covered = np.zeros(len(starts) + 3, dtype=bool)
    for j in range(3):
        covered[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(spread(counts)[covered[: len(starts)]], minlength=n)

    ls, le, lfirst = block.runs(data != 10)
    solid = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kind != 4, out=solid[1:])
    worded = solid[le] > solid[ls]
    line_owner = spread(np.diff(lfirst))[worded]
    line_hash = block.hashes(ls[worded], le[worded])
    out["n_dup_lines"] = np.bincount(line_owner, minlength=n) - _distinct(line_owner, line_hash, n)

    classes = np.stack([block.sums(kind == k) for k in range(CLASSES)], axis=1)
    rs, re, rfirst = block.runs(LETTER[data])
    tokens = block.hashes(rs, re, lower=True)
    place = np.minimum(np.searchsorted(refs.hashes, tokens), len(refs.hashes) - 1)
    hit = refs.hashes[place] == tokens
    words = np.bincount(spread(np.diff(rfirst))[hit] * len(refs.hashes) + place[hit], minlength=n * len(refs.hashes)).reshape(n, -1)
    total = np.diff(rfirst)
    by_class = np.stack([js_distance(classes.astype(float), q) for q in refs.classes], axis=1)
    by_word = []
    for columns, q in zip(refs.columns, refs.words, strict=True):
        own = words[:, columns].astype(float)
        by_word.append(js_distance(np.concatenate([own, (total - own.sum(1))[:, None]], axis=1), q))
    by_word = np.stack(by_word, axis=1)
    best = np.argmin(by_class + by_word, axis=1)
    out["closest"] = best
    out["class_distance"] = by_class[np.arange(n), best]
    out["word_distance"] = by_word[np.arange(n), best]
    out["base_failed"] = (counts < 50) | (100 * out["n_repeat_words"] > 50 * counts)
    letters = classes[:, 0] + classes[:, 1] + classes[:, 2]
    foreign = 2 * block.sums(FAR[data]) > letters
    out["closest"] = np.where(foreign, -1, best)
    odd = (classes.sum(1) >= MIN_LETTERS) & (out["class_distance"] > MAX_CLASS_DISTANCE)
    odd |= (letters >= MIN_LETTERS) & (total >= MIN_TOKENS) & (out["word_distance"] > MAX_WORD_DISTANCE)
    out["kept"] = ~out["base_failed"] & (foreign | ~odd)
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, closest string, class_distance double, word_distance double"


def score_quality(docs: DataFrame, text: str = "text", key: str = "doc_id", refs: References | None = None) -> DataFrame:
    """One row per document: ``key``, the counts, the distances to the closest language, and the verdict."""
    refs = refs or References()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, text):
            m = measure(text_column(batch, text), refs)
            m["closest"] = np.array([*refs.languages, "und"], dtype=object)[m["closest"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[f.split()[0]]) for f in FIELDS.split(", "))], [key, *(f.split()[0] for f in FIELDS.split(", "))])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {FIELDS}")


def filter_quality(docs: DataFrame, text: str = "text", refs: References | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    refs = refs or References()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, text):
            yield batch.filter(pa.array(measure(text_column(batch, text), refs)["kept"]))

    return docs.mapInArrow(run, docs.schema)

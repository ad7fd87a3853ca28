"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score for a language is its log probability under hashed character trigrams learned from labelled rows. The
switching penalty keeps single odd words from breaking a span. Viterbi runs over all texts of a batch at once: texts are
cut into blocks, each block yields a max-plus transfer matrix, blocks are chained per text, and paths are traced back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import bounded_batches, mix, slices, tidy, words

BUCKETS = 1 << 16
SAMPLE_ROWS = 2000  #: labelled rows of each language that the model is fitted on (expected number; drawn by id hash)
BLOCK = 128
NEVER = -1e4

#: First and last code point of each script's blocks.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = [*SCRIPTS, "other"]
OTHER = len(NAMES) - 1


def _script_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            table[first : last + 1] = k
    return table


_tables: dict[str, np.ndarray] = {}


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(script, is a letter) of each code point."""
    if not _tables:
        _tables["script"] = _script_table()
        every = np.arange(0x110000, dtype="<u4")
        every[0xD800:0xE000] = 0x20
        text = every.tobytes().decode("utf-32-le")
        _tables["letter"] = np.fromiter((c.isalpha() for c in text), bool, len(text))
    return _tables["script"], _tables["letter"]


@dataclass
class WordFeatures:
    """Of dictionary words: hashed trigrams in one flat array with the words' offsets, main script, and letters."""

    grams: np.ndarray
    offsets: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def features(names: pa.Array) -> WordFeatures:
    """Trigrams of each word's letters, lower case, with an edge mark at both ends; words without letters have none."""
    script, letter = char_tables()
    lowered = pc.utf8_lower(names)
    text = "".join(lowered.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum(pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)) if len(names) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(names)), np.diff(ends, prepend=0))
    keep = letter[points]
    points, word = points[keep], word[keep]
    letters = np.bincount(word, minlength=len(names)).astype(np.int64)
    counts = np.zeros((len(names), len(NAMES)), np.int32)
    np.add.at(counts, (word, script[points]), 1)
    some = letters > 0
    # each word with letters becomes: mark, letters, mark; its trigrams begin at each of the first ``letters`` places
    starts = np.concatenate([[0], np.cumsum(np.where(some, letters + 2, 0))])
    padded = np.zeros(starts[-1], np.uint64)
    rank = np.arange(len(points)) - np.repeat(np.cumsum(letters) - letters, letters)
    padded[starts[word] + 1 + rank] = points.astype(np.uint64)
    at = starts[word] + rank
    first, second, third = padded[at], padded[at + 1], padded[at + 2] if len(at) else padded[at]
    grams = mix(first * np.uint64(1 << 42) + second * np.uint64(1 << 21) + third) % np.uint64(BUCKETS)
    return WordFeatures(grams.astype(np.int64), np.concatenate([[0], np.cumsum(letters)]), counts.argmax(1), letters)


@dataclass
class Model:
    """Languages, log probabilities of trigram buckets (buckets x languages), and which languages use each script."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, share: float = 1e-3, smoothing: float = 0.3) -> Model:
    """Fit on about ``sample_rows`` rows of each language of ``labelled`` (doc_id, text, lang); rows without either are passed over.

    The driver gets at most ``BUCKETS`` trigram counts and a row of script counts for each language."""
    bounded_batches(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und"))
    totals = usable.groupBy("lang").count().collect()  # a row for each language
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share_of = F.create_map([F.lit(x) for lang, n in totals for x in (lang, sample_rows / n)]) if totals else F.create_map().cast("map<string,double>")
    sample = usable.where(drawn < F.coalesce(share_of[F.col("lang")], F.lit(0.0)))

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for some in slices(batch, "text"):
                codes, names, offsets = words(some.column("text"))
                seen, langs = features(names), some.column("lang").to_pylist()
                for lang in set(langs):
                    own = np.repeat([x == lang for x in langs], np.diff(offsets))
                    times = np.bincount(codes[own], minlength=len(names))
                    total = np.bincount(seen.grams, np.repeat(times, seen.letters), BUCKETS)
                    by = np.bincount(seen.script, times * seen.letters, len(NAMES))
                    grams[lang] = grams.get(lang, 0) + total
                    scripts[lang] = scripts.get(lang, 0) + by
        rows = [(lang, int(b), float(v[b])) for lang, v in grams.items() for b in np.flatnonzero(v)]
        rows += [(lang, -1 - int(k), float(v[k])) for lang, v in scripts.items() for k in np.flatnonzero(v)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["lang", "bucket", "n"])

    rows = sample.select("text", "lang").mapInArrow(tidy(count), "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    for lang, bucket, n in rows:
        if bucket >= 0:
            counts[bucket, langs.index(lang)] = n
        else:
            scripts[-1 - bucket, langs.index(lang)] = n
    # buckets that no language has say nothing: smoothing is in proportion to how common a bucket is in all languages
    base = (counts.sum(1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    weight = smoothing * 1e3
    logp = np.log((counts + weight * base) / (counts.sum(0, keepdims=True) + weight))
    allowed = scripts >= share * np.maximum(scripts.sum(0, keepdims=True), 1)
    return Model(langs, (logp - logp.mean(1, keepdims=True)).astype(np.float32), allowed)


def word_scores(model: Model, seen: WordFeatures) -> np.ndarray:
    """Scores (words x languages): 0 for words without letters or in a script that no language uses."""
    out = np.zeros((len(seen.letters), len(model.langs)), np.float32)
    some = seen.letters > 0
    if some.any():
        out[some] = np.add.reduceat(model.logp[seen.grams], seen.offsets[:-1][some], axis=0)
        fits = model.allowed[seen.script]
        out = np.where(fits | ~fits.any(1, keepdims=True), out, np.float32(NEVER))
        out[~some | (~fits.any(1) & some)] = 0
    return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word of each text (runs ``offsets`` of ``scores``); ties go to the smaller label."""
    n_labels, lengths = scores.shape[1], np.diff(offsets)
    if not len(scores):
        return np.zeros(0, np.int64)
    per = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[text] + nth * BLOCK
    size = np.minimum(BLOCK, offsets[text + 1] - start)
    by = np.argsort(-size, kind="stable")  # at step t the blocks that go on are a prefix
    start, size = start[by], size[by]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    stay = np.full((n_labels, n_labels), -penalty, np.float32)
    np.fill_diagonal(stay, 0)

    def forward(value: np.ndarray, back: np.ndarray | None) -> np.ndarray:
        """value: (blocks, entries, labels) before the first word."""
        for t in range(steps):
            k = active[t]
            v = value[:k]
            best = v.max(2, keepdims=True) - np.float32(penalty)
            move = best > v
            if back is not None:
                back[t, :k] = np.where(move[:, 0], v[:, 0].argmax(1)[:, None], np.arange(n_labels))
            value[:k] = np.where(move, best, v) + scores[start[:k] + t][:, None, :]
        return value

    # transfer of each block that is not a text's last one: entry label -> exit label
    entry = np.broadcast_to(np.where(np.eye(n_labels, dtype=bool), np.float32(0), np.float32(-1e9)), (len(start), n_labels, n_labels)).copy()
    many = per.max() > 1
    if many:
        transfer = forward(entry, None)
    before = np.zeros((len(start), n_labels), np.float32)
    sorted_place = np.empty(len(by), np.int64)
    sorted_place[by] = np.arange(len(by))
    base, long_first = np.cumsum(per) - per, np.argsort(-per, kind="stable")
    blocks_of = lambda b: base[long_first[: np.searchsorted(-per[long_first], -b, side="left")]] + b  # noqa: E731  of the texts with over b blocks
    for b in range(1, int(per.max())):
        at = blocks_of(b)
        at, last = sorted_place[at], sorted_place[at - 1]
        own = (before[last][:, :, None] + transfer[last]).max(1)
        before[at] = own - own.max(1, keepdims=True)  # keeps single precision exact enough on long texts
    back = np.zeros((steps, len(start), n_labels), np.int16 if n_labels > 127 else np.int8)
    final = forward(before[:, None, :].copy(), back)[:, 0]
    # the label before a block that each label at its end comes from, for all blocks at once; then the ends, from the last block on
    came = np.broadcast_to(np.arange(n_labels), (len(start), n_labels)).copy() if many else None
    if many:
        for t in range(steps - 1, -1, -1):
            k = active[t]
            came[:k] = np.take_along_axis(back[t, :k].astype(np.int64), came[:k], axis=1)
    now = final.argmax(1)
    for b in range(int(per.max()) - 1, 0, -1):
        at = blocks_of(b)
        at, last = sorted_place[at], sorted_place[at - 1]
        now[last] = came[at, now[at]]
    labels = np.zeros(len(scores), np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        labels[start[:k] + t] = now[:k]
        now[:k] = back[t, np.arange(k), now[:k]]
    return labels


@dataclass
class Labels:
    """Of texts: best language, the share of the letters that are evidence of it, and spans (text, first, past, language number)."""

    pred: list[str]
    score: np.ndarray
    spans: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def label_texts(model: Model, texts: pa.Array, penalty: float) -> Labels:
    codes, dictionary, offsets = words(texts)
    rows, n, seen = len(texts), len(model.langs), features(dictionary)
    letters = seen.letters[codes]
    text = np.repeat(np.arange(rows), np.diff(offsets))
    total = np.bincount(text, letters, rows)
    known = total > 0
    if not n or not known.any():
        return Labels(["und"] * rows, np.zeros(rows), (np.zeros(0, np.int64),) * 4)
    labels = viterbi(word_scores(model, seen)[codes], offsets, penalty)
    told = model.allowed[seen.script].any(1)[codes]  # words of a script that no language uses are evidence of none
    by = np.bincount(text * n + labels, letters * told, rows * n).reshape(rows, n)
    best = by.argmax(1)
    score = np.where(known, by[np.arange(rows), best] / np.maximum(total, 1), 0.0)
    first = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])]))
    past = np.append(first[1:], len(labels))
    some = known[text[first]]
    first, past = first[some], past[some]
    own = text[first]
    pred = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
    return Labels(pred, score, (own, first - offsets[own], past - offsets[own], labels[first]))


RESULT = "doc_id long, lang_pred string, score double, spans array<struct<first:int,past:int,lang:string>>"


def label(docs: DataFrame, model: Model, penalty: float = 8.0) -> DataFrame:
    """Label spans of ``docs`` (doc_id, text): doc_id, lang_pred, score, spans (first and past-the-last word, language).

    lang_pred is the language with most letters in its spans (ties: alphabetic), score their share of all letters; letters of words in a
    script that no language of the model uses count for none, so a text of such words alone has some language with score 0. Null,
    empty and letterless texts give ``und`` with score 0 and no spans, as does a model without languages. Rows that repeat
    are labelled each; a null doc_id stays null; an empty table gives no rows; other columns are ignored."""

    def run(batches):
        names = pa.array(model.langs, pa.string())
        for batch in batches:
            for some in slices(batch, "text"):
                found = label_texts(model, some.column("text"), penalty)
                text, first, past, lang = found.spans
                parts = [pa.array(first.astype(np.int32)), pa.array(past.astype(np.int32)), names.take(pa.array(lang))]
                spans = pa.StructArray.from_arrays(parts, ["first", "past", "lang"])
                cuts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=some.num_rows))]).astype(np.int32)
                out = [some.column("doc_id"), pa.array(found.pred), pa.array(found.score), pa.ListArray.from_arrays(pa.array(cuts), spans)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), RESULT)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, penalty: float = 8.0) -> DataFrame:
    """``docs`` without the rows that ``label`` rejects: no language, or none with ``least_score`` of the letters; all columns stay."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                found = label_texts(model, some.column("text"), penalty)
                yield some.filter(pa.array((found.score >= least_score) & (np.array(found.pred) != "und")))

    return docs.mapInArrow(tidy(run), docs.schema)

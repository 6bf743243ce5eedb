"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Lexicons. One is a fixed list of insults. The other is learned from labels: prefixes of words, of
MIN_PREFIX letters to a parameter (MAX_PREFIX, or None for whole words), that far more toxic than other documents hold, in two
tiers by likelihood ratio; every prefix above a tier's bound is in it. Features of training rows use a lexicon learned without
their own fold. Of training rows of one label that hold the same words, one counts for the lexicon.

Features: densities of both lexicons, hits near second-person words, hits that only show when
look-alike characters are put back (obfuscation), capitals, exclamation marks, punctuation,
symbols, digits, repeated words, lengths. Neither counts nor densities are held at a bound.

Trees are fitted on folds 0 and 1, the isotonic curve on fold 3, on a sample of at most about
MAX_ROWS labelled rows. The score is the calibrated probability, with a hundredth of the uncalibrated
one so that documents within a step of the curve stay in order.

Null and empty texts have no words: all features 0 and the score these give. With labels of one class
or none the score is the share of label 1, 0 without any. Repeated rows and equal or null doc_ids each
give a row. Columns other than doc_id and text are left out; label columns are read from the labels alone.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, fold, written
from .labelled import HELD_OUT, MAX_ROWS, training_rows
from .text_features import CLASSES, byte_classes

# Insults in English.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass trash garbage loser losers worthless disgusting pathetic clown clowns "
    "scum scumbag filth filthy vermin imbecile cretin fool jerk bastard bitch asshole shit crap fuck fucking "
    "retard retarded ugly creep freak degenerate subhuman pig swine hate kill die".split()
)
# Second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus".split())
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None})
_EDGE = "\"'()[]{}.,;:!?*&%$#|<>-_…«»¿¡"

MIN_PREFIX, MAX_PREFIX = 4, 8
STRONG, WEAK = 22.0, 12.0
NEAR = 4
_INSULT, _STRONG, _WEAK, _SECOND, _HIDDEN = 1, 2, 4, 8, 16
N_FEATURES = 18


def prefixes(word: str, longest: int | None = MAX_PREFIX) -> list[str]:
    return [word[:k] for k in range(MIN_PREFIX, (len(word) if longest is None else min(longest, len(word))) + 1)]


def _bare(word: str) -> str:
    return word.strip(_EDGE)


def ratio(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Likelihood ratio statistic for toxic documents holding a prefix more often than clean ones; 0 if not more often."""
    n, rate = toxic + clean, all_toxic / max(1.0, all_toxic + all_clean)
    if not n or toxic / n <= rate or not 0 < rate < 1:
        return 0.0
    return 2 * (toxic * math.log(toxic / n / rate) + (clean * math.log(clean / n / (1 - rate)) if clean else 0.0))


def _ratio(toxic: Column, clean: Column, all_toxic: float, all_clean: float) -> Column:
    """ratio() over columns."""
    n, rate = toxic + clean, all_toxic / max(1.0, all_toxic + all_clean)
    if not 0 < rate < 1:
        return F.lit(0.0)
    of_clean = F.when(clean > 0, clean * F.ln(clean / n / (1 - rate))).otherwise(0.0)
    return F.when((n > 0) & (toxic / n > rate), 2 * (toxic * F.ln(toxic / n / rate) + of_clean)).otherwise(0.0)


class Lexicon(dict):
    """Flags by word; prefixes decide, and words are remembered until there are too many."""

    def __init__(self, strong: frozenset[str], weak: frozenset[str], longest: int | None = MAX_PREFIX):
        self.strong, self.weak, self.longest = strong, weak, longest

    def _hit(self, word: str) -> int:
        flags = _INSULT if word in INSULTS else 0
        for p in prefixes(word, self.longest):
            if p in self.strong:
                return flags | _STRONG | _WEAK
            if p in self.weak:
                flags |= _WEAK
        return flags

    def __missing__(self, word: str) -> int:
        bare = _bare(word)
        flags = self._hit(bare) | (_SECOND if bare in SECOND_PERSON else 0)
        if not flags & (_INSULT | _STRONG) and not bare.isalpha() and any(c.isalpha() for c in bare):
            seen = self._hit(bare.translate(_LOOKALIKE))
            if seen & (_INSULT | _STRONG):
                flags |= seen | _HIDDEN
        if len(self) > 500_000:
            self.clear()
        self[word] = flags
        return flags


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    words = text.lower().split()
    if not words:
        return out
    n = len(words)
    flags = np.array(list(map(lexicon.__getitem__, words)), np.uint8)
    hits = (flags & (_INSULT | _STRONG)) > 0
    near = 0
    if hits.any() and (second := np.flatnonzero(flags & _SECOND)).size:
        at = np.flatnonzero(hits)
        k = np.searchsorted(second, at)
        ahead = np.abs(second[np.minimum(k, len(second) - 1)] - at)
        behind = np.abs(at - second[np.maximum(k - 1, 0)])
        near = int((np.minimum(ahead, behind) <= NEAR).sum())
    raw = text.encode("utf-8", "surrogatepass")
    c = dict(zip(CLASSES, byte_classes(raw)))
    letters = c["upper"] + c["lower"] + 1
    counts = [int((flags & f > 0).sum()) for f in (_INSULT, _STRONG, _WEAK, _HIDDEN)]
    distinct = len(set(words))
    out[:] = (
        100 * counts[0] / n,
        100 * counts[1] / n,
        100 * counts[2] / n,
        100 * counts[3] / n,
        counts[0],
        counts[1],
        100 * near / n,
        100 * hits.sum() / n,
        c["upper"] / letters,
        100 * c["bang"] / len(raw),
        100 * c["point"] / len(raw),
        100 * c["symbol"] / len(raw),
        100 * c["digit"] / len(raw),
        100 * c["bar"] / len(raw),
        distinct / n,
        math.log1p(n),
        len(raw) / n,
        int(hits.sum()),
    )
    return out


def _count_prefixes(batches: Iterator[pa.RecordBatch], longest: int | None) -> Iterator[pa.RecordBatch]:
    """Documents that hold a prefix, by fold and label; side is 2 * fold + label."""
    held: dict[int, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for side, counts in held.items():
            yield pa.record_batch([pa.array(list(counts)), pa.array([side] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["prefix", "side", "n"])
        held.clear()

    for batch in batches:
        for text, label, part in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold"))):
            held[2 * part + label].update({p for w in set(text.lower().split()) for p in prefixes(_bare(w), longest)})
        if sum(map(len, held.values())) > 1_000_000:
            yield from out()
    yield from out()


def learn_lexicons(rows: DataFrame, longest: int | None = MAX_PREFIX) -> dict[int | None, tuple[frozenset[str], frozenset[str]]]:
    """(strong, weak) prefixes, without each training fold, and under None from all of them.

    Of rows of one label with the same set of words, the one with the smallest doc_id counts: else every word of a
    toxic text that was copied would look toxic.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    alike = F.sha2(F.array_join(F.array_sort(words), " "), 256)
    first = F.min_by(F.struct("doc_id", "text", "label", "fold"), F.struct("doc_id", F.xxhash64("text"))).alias("row")
    rows = written(rows.groupBy(alike.alias("alike"), F.col("label").alias("of")).agg(first).select("row.*"), "unlike")
    totals = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    sides = [2 * f + y for f in (0, 1, 3) for y in (0, 1)]
    counts = rows.mapInArrow(partial(_count_prefixes, longest=longest), "prefix string, side int, n long").groupBy("prefix")
    counts = counts.agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in sides])
    made = {None: (0, 1, 3), 0: (1, 3), 1: (0, 3), 3: (0, 1)}
    all_of = {left_out: tuple(sum(totals.get((f, y), 0) for f in inside) for y in (1, 0)) for left_out, inside in made.items()}
    held = lambda inside, y: sum((F.col(f"n{2 * f + y}") for f in inside), F.lit(0))
    # the sample is bounded, and so are the prefixes of it that lean to toxic texts
    likely = [_ratio(held(inside, 1), held(inside, 0), *all_of[left_out]) >= WEAK for left_out, inside in made.items()]
    found = counts.where(reduce(lambda a, b: a | b, likely)).collect()
    lexicons: dict[int | None, tuple[frozenset[str], frozenset[str]]] = {}
    for left_out, inside in made.items():
        t, c = all_of[left_out]
        scored = [(ratio(sum(r[f"n{2 * f + 1}"] for f in inside), sum(r[f"n{2 * f}"] for f in inside), t, c), r.prefix) for r in found]
        lexicons[left_out] = (frozenset(p for g, p in scored if g >= STRONG), frozenset(p for g, p in scored if g >= WEAK))
    return lexicons


def _featured(lexicons, columns: tuple[str, ...], longest: int | None = MAX_PREFIX):
    """features of each text; with a column fold, by the lexicon learned without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: Lexicon(*v, longest) for k, v in lexicons.value.items()}
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                folds = batch.column("fold").to_pylist() if "fold" in columns else [None] * batch.num_rows
                x = np.stack([features(t, known[f]) for t, f in zip(batch.column("text").to_pylist(), folds)])
                ends = pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32))
                yield pa.record_batch([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [*columns, "x"])

    return run


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_ROWS, trees: int = 20, longest: int | None = MAX_PREFIX) -> DataFrame:
    """doc_id, held_out, score, predicted, margin (of the trees) of each document."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    docs = documents_of(documents)
    spark = docs.sparkSession
    held_out = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    rows = training_rows(documents, labels, "toxic", most)
    share = {(r.calibrates, r.label): r.n for r in rows.groupBy((F.col("fold") == 3).alias("calibrates"), "label").agg(F.count("*").alias("n")).collect()}
    if not all(share.get((calibrates, y)) for calibrates in (False, True) for y in (0, 1)):
        known = rows.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        score = F.lit(float(known))
        return docs.select("doc_id", held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.lit(0.0).alias("margin"))
    lexicons = spark.sparkContext.broadcast(learn_lexicons(rows, longest))
    train = rows.mapInArrow(_featured(lexicons, ("label", "fold"), longest), "label int, fold int, x array<double>")
    train = written(train, "features").select(F.col("label").cast("double").alias("label"), "fold", array_to_vector("x").alias("features")).coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.2, maxBins=32, minInstancesPerNode=5, seed=7, maxMemoryInMB=64).fit(train.where("fold <> 3"))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    calibration = model.transform(train.where("fold = 3")).select("label", margin)
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(calibration)
    scored = docs.mapInArrow(_featured(lexicons, ("doc_id",), longest), "doc_id long, x array<double>").select("doc_id", array_to_vector("x").alias("features"))
    scored = curve.transform(model.transform(scored).select("doc_id", margin))
    score = 0.99 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated"))) + 0.01 / (1 + F.exp(-2 * F.col("margin")))
    return scored.select("doc_id", held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "margin")

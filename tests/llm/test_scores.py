import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meridia.llm import lm_score, mixing, quality, toxicity
from meridia.llm.common import frequent
from meridia.llm.labelled import training_rows

from .cases import frame, rows

LABELS = "doc_id long, quality int, toxic int, text string, score string"


def labelled(spark, n=900, seed=8):
    """Clean prose, shouting junk, and toxic prose with a stem of its own that only labels tell of."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "men", "tas", "vio", "pre") for b in ("em", "tion", "ing", "o", "ra", "um")]
    docs, labels = [], []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        good, toxic = r.random() > 0.25, r.random() < 0.2
        if toxic:
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(("you idiot", "worthless", "1d1ot")) if k % 2 else "zorg" + r.choice(words)
        text = " ".join(text) if good else "!! ".join(text).upper() + " $$$ %%%"
        docs.append((1000 + k, text, "en", "src1", len(text), 1, 2, 3, 4, 0.5))
        labels.append((1000 + k, int(good), int(toxic), "x", None))
    labels += [(None, 1, 1, None, None), (5, None, None, None, None), (7, 1, 0, "x", None), (7, 1, 0, "x", None)]
    return frame(spark, docs + rows()), spark.createDataFrame(labels, LABELS), {d[0]: (d[1], lab) for d, lab in zip(docs, labels)}


@pytest.mark.parametrize("score,column,threshold", [(toxicity.toxicity_scores, 2, 0.3), (quality.quality_scores, 1, 0.7)])
def test_classifiers_on_the_held_out_fold(spark, score, column, threshold):
    docs, labels, truth = labelled(spark)
    got = score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    right = []
    for r in got:
        held_out = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == held_out and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id][1][column])
    assert len(right) > 150 and np.mean(right) > 0.97


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_without_labels_or_documents(spark, score):
    _, labels, _ = labelled(spark, 40)
    none = spark.createDataFrame([], LABELS)
    assert score(frame(spark, []), labels).count() == 0
    assert len({r.score for r in score(frame(spark), none).collect()}) == 1


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark, 200)
    read = training_rows(docs, labels, "toxic")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in read.collect())
    assert training_rows(docs, labels, "toxic", most=50).count() < 100


def test_lexicons_have_no_bound_of_their_own(spark):
    """Whole words by parameter; equal words count once a label, other texts always; every prefix above a bound is there."""
    toxic = [f"{a}{b}x {c}" for a in "abcdefghij" for b in ("lorem", "dolor") for c in ("amet", "elit")]
    rows_ = [(k, t, 1, k % 2) for k, t in enumerate(toxic)] + [(100 + k, f"clean{k} words", 0, k % 2) for k in range(40)]
    schema = "doc_id long, text string, label int, fold int"
    short, whole = (toxicity.learn_lexicons(spark.createDataFrame(rows_, schema), longest) for longest in (toxicity.MAX_PREFIX, None))
    assert short == whole and short[None][1]
    # the same words again, in another order, change nothing; one word more makes another text
    again = [(200 + k, " ".join(reversed(t.split())), 1, k % 2) for k, t in enumerate(toxic)]
    assert toxicity.learn_lexicons(spark.createDataFrame(rows_ + again, schema)) == short
    more = [(300, "longwordindeed zzzz", 1, 0)] + [(301 + k, f"longwordindeed zzzz w{k}", 1, k % 2) for k in range(30)]
    lexicon = toxicity.learn_lexicons(spark.createDataFrame(rows_ + more, schema), None)
    assert "longwordindeed" in lexicon[None][0] and toxicity.Lexicon(*lexicon[None], None)["longwordindeed"] & toxicity._STRONG
    assert max(map(len, toxicity.learn_lexicons(spark.createDataFrame(rows_ + more, schema))[None][0])) == toxicity.MAX_PREFIX


def test_toxicity_features_against_plain_loops():
    strong, weak = frozenset({"zorg"}), frozenset({"zorg", "blam"})
    lexicon = toxicity.Lexicon(strong, weak)
    r = random.Random(3)
    words = ["you", "idiot", "Zorgish,", "blamed", "fine", "1d1ot", "day!", "YOUR", "z0rg-x", "a.", "12", "|", "tu", "$$"]
    for n in (0, 1, 3, 12, 60):
        text = " ".join(r.choice(words) for _ in range(n))
        got = toxicity.features(text, lexicon)
        low = text.lower().split()
        if not low:
            assert not got.any()
            continue
        bare = [w.strip("\"'()[]{}.,;:!?*&%$#|<>-_…«»¿¡") for w in low]

        def seen(w):
            return (w in toxicity.INSULTS, any(w[:k] in strong for k in range(4, 9)), any(w[:k] in weak for k in range(4, 9)))

        back = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None})
        flags = []
        for w in bare:
            insult, hard, soft = seen(w)
            hidden = False
            if not (insult or hard) and not w.isalpha() and any(c.isalpha() for c in w):
                i2, h2, s2 = seen(w.translate(back))
                if i2 or h2:
                    insult, hard, soft, hidden = i2, h2, soft or s2, True
            flags.append((insult, hard, soft, hidden))
        hits = [k for k, f in enumerate(flags) if f[0] or f[1]]
        second = [k for k, w in enumerate(bare) if w in toxicity.SECOND_PERSON]
        near = sum(any(abs(a - b) <= 4 for b in second) for a in hits)
        counts = [sum(f[k] for f in flags) for k in range(4)]
        assert np.allclose(got[:4], [100 * c / n for c in counts]) and got[4] == counts[0] and got[5] == counts[1]
        assert np.allclose(got[6:8], [100 * near / n, 100 * len(hits) / n])
        upper, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
        assert np.isclose(got[8], upper / (letters + 1)) and np.isclose(got[9], 100 * text.count("!") / len(text))
        assert np.isclose(got[14], len(set(low)) / n) and np.isclose(got[15], math.log1p(n)) and got[17] == len(hits)


def test_lexicons_against_counts(spark):
    r = random.Random(6)
    rows_ = []
    for k in range(400):
        text = [f"w{r.randrange(300)}word" for _ in range(25)]
        label = int(r.random() < 0.25)
        text += [f"vile{r.randrange(3)}"] if label and r.random() < 0.8 or not label and r.random() < 0.05 else []
        rows_.append((k, " ".join(text), label, (0, 1, 3)[k % 3]))
    rows_.append((900, rows_[5][1], rows_[5][2], 0))  # a copy counts once, and the first of the two
    made = toxicity.learn_lexicons(spark.createDataFrame(rows_, "doc_id long, text string, label int, fold int"))
    for left_out, (strong, weak) in made.items():
        inside = [x for x in rows_[:400] if x[3] != left_out]
        counts = {y: Counter(p for x in inside if x[2] == y for p in {p for w in x[1].split() for p in toxicity.prefixes(w)}) for y in (0, 1)}
        t, c = (sum(x[2] == y for x in inside) for y in (1, 0))
        found = {p: toxicity.ratio(counts[1][p], counts[0][p], t, c) for p in counts[1]}
        assert strong == {p for p, g in found.items() if g >= toxicity.STRONG} and weak == {p for p, g in found.items() if g >= toxicity.WEAK}
        assert "vile" in strong


def test_quality_features_against_plain_loops():
    r = random.Random(4)
    for n in (0, 1, 30):
        text = "".join(r.choice(["Word ", "12! ", "averyverylongword ", "same same ", "$|.\n", "line\nline\n", "\t"]) for _ in range(n))
        got = dict(zip(quality.FEATURES, quality.features(text)))
        words = text.split()
        if not words:
            assert not any(got.values())
            continue
        lines = [x for x in text.split("\n") if x]
        w = len(words)
        assert math.isclose(got["capitals"], sum(c.isupper() for c in text) / (sum(c.isalpha() for c in text) + 1))
        assert math.isclose(got["digits"], sum(c.isdigit() for c in text) / len(text)) and math.isclose(got["bangs"], text.count("!") / w)
        assert math.isclose(got["bars"], text.count("|") / w) and math.isclose(got["symbols"], text.count("$") / w) and math.isclose(got["points"], text.count(".") / w)
        assert math.isclose(got["spaces"], (text.count(" ") + text.count("\t")) / len(text)) and math.isclose(got["word_length"], len(text) / w)
        assert math.isclose(got["long_words"], sum(len(x) > 12 for x in words) / w) and math.isclose(got["distinct"], len(set(words)) / w)
        assert math.isclose(got["top_word"], max(words.count(x) for x in words) / w)
        assert math.isclose(got["same_as_last"], sum(a == b for a, b in zip(words, words[1:])) / w)
        assert math.isclose(got["line_repeats"], 1 - len(set(lines)) / max(1, len(lines))) and math.isclose(got["words_per_line"], w / max(1, len(lines)))


def test_additive_model_of_one_feature_is_a_boosted_table():
    """One round on two values: the steps by hand."""
    x = np.repeat([[0.0], [1.0]], [30, 50], axis=0)
    y = np.concatenate([np.arange(30) % 3 == 0, np.arange(50) % 5 > 0]).astype(float)
    rounds, quality.ROUNDS = quality.ROUNDS, 1
    try:
        model = quality.AdditiveModel.fit(x, y, np.zeros(80, bool))
    finally:
        quality.ROUNDS = rounds
    p = y.mean()
    step = lambda part: quality.RATE * sum(part - p) / (len(part) * p * (1 - p) + 1)
    assert np.allclose(model.raw(x) - model.intercept, np.repeat([step(y[:30]), step(y[30:])], [30, 50]))


def test_accepted_documents_keep_columns(spark):
    docs, labels, _ = labelled(spark, 400)
    kept = quality.accepted_documents(docs, labels)
    assert kept.columns == docs.columns
    scores = Counter(r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect())
    assert Counter(r.doc_id for r in kept.collect()) == scores


def test_additive_model_adds_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel.fit(x, y, np.arange(800) % 4 == 0)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    total = model.intercept
    for j, t in enumerate(model.tables):
        total += t[np.searchsorted(model.edges[j], x[5, j], side="right")]
    for (i, j), t in model.pairs.items():
        total += t[np.searchsorted(model.pair_edges[i], x[5, i], side="right"), np.searchsorted(model.pair_edges[j], x[5, j], side="right")]
    assert math.isclose(total, model.raw(x[5:6])[0])


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        open_ -= over
    return target


def test_mix_against_brute_force(spark):
    data = rows()
    got = mixing.mix(frame(spark, data)).collect()
    size = lambda t: len([w for w in (t or "").encode().split()])
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size(r[1])
    target = brute_targets(sizes)
    known = {r[0]: r for r in data if r[0] is not None}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in data)
    taken = Counter()
    for r in got:
        source = known[r.doc_id][3] if r.doc_id is not None else ("src0" if r.size else None)
        taken[source] += r.taken
        assert r.source_size == sizes[source] and math.isclose(r.target, target[source])
        assert 0 <= r.taken <= 2 * r.size
    for source, t in target.items():
        assert abs(taken[source] - t) < 1
    again = mixing.mix(frame(spark, data).repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


@pytest.mark.parametrize("packets", [1 << 16, 2])
def test_mix_is_cut_where_the_running_total_reaches_the_budget(spark, monkeypatch, packets):
    import hashlib

    monkeypatch.setattr(mixing, "PACKETS", packets)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(mixing, "GROUP", 2)
    data = [r for r in rows(90, 9) if r[0] is not None and r[0] != 107]
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    size = {r[0]: len((r[1] or "").encode().split()) for r in data}
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size[r[0]]
    target, items = brute_targets(sizes), []
    for source in sizes:
        end = 0
        for turn in (0, 1):
            for _, k in sorted((md5(f"{r[0]}:{turn}:{md5(r[1] or '')}"), r[0]) for r in data if r[3] == source):
                start, end = end, end + size[k]
                step = -(-size[k] // packets) if start < target[source] < end else size[k]
                items += [(min(at + step, end) / target[source], k, turn, min(at + step, end) - at) for at in range(start, end, step or 1)]
    budget, taken, first = int(1.5 * sum(size.values())), Counter(), {}
    for finish, k, _, words in sorted(items):
        served = min(words, budget)
        budget -= served
        taken[k] += served
        if served:
            first.setdefault(k, finish)
    assert budget == 0
    got = mixing.mix(frame(spark, data)).collect()
    assert {r.doc_id: r.taken for r in got} == {k: taken[k] for k in size}
    assert {r.doc_id: r.first_finish for r in got if r.taken} == first


def test_mixed_documents_are_what_is_taken(spark):
    data = rows()
    docs = frame(spark, data)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    blank = frame(spark, [(1, " ", "en", "a", 1, 1, 1, 1, 1, 1.0), (2, None, "en", None, 1, 1, 1, 1, 1, 1.0)])
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(blank).count() == 0


class BruteModels:
    """Both models over (doc_id, text) of all documents and of the target; scores leave a row's own counts out."""

    def __init__(self, data, target):
        self.all, self.target, self.members = self.counts(t for _, t in data), self.counts(t for _, t in target), {k for k, _ in target}
        self.size = len(set(self.all[0]) | set(self.target[0])) + 1

    @staticmethod
    def counts(texts):
        single, pairs, n = Counter(), Counter(), 0
        for text in texts:
            words = lm_score.words_of(text or "")
            single.update([b"", *words])
            pairs.update(zip([b"", *words], words))
            n += len(words)
        return single, pairs, n

    def loss(self, text, model, own, scale):
        words, total = lm_score.words_of(text or ""), 0.0
        c = lambda k, key: max(0, model[k][key] - own[k][key]) * scale
        for u, w in zip([b"", *words], words):
            p = (c(0, w) + 1) / (max(0, model[2] - own[2]) * scale + self.size - 1)
            total -= math.log((c(1, (u, w)) + lm_score.PRIOR * p) / (c(0, u) + lm_score.PRIOR))
        return total / max(1, len(words))

    def losses(self, doc_id, text):
        own, nothing = self.counts([text]), (Counter(), Counter(), 0)
        target = self.loss(text, self.target, own if doc_id in self.members else nothing, 1.0)
        return target, self.loss(text, self.all, own, self.target[2] / self.all[2])


def test_lm_scores_against_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    target = [r for r in data if r[0] % 3 == 0]
    got = lm_score.cross_entropy_difference(frame(spark, data), frame(spark, target)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in data)
    models, texts = BruteModels([r[:2] for r in data], [r[:2] for r in target]), dict(r[:2] for r in data)
    for r in got:
        t, b = models.losses(r.doc_id, texts[r.doc_id])
        assert math.isclose(r.target_loss, t, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.background_loss, b, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.difference, t - b, rel_tol=1e-6, abs_tol=1e-9)


def test_lm_scores_without_target_or_documents(spark):
    got = lm_score.cross_entropy_difference(frame(spark), frame(spark, [])).collect()
    assert len(got) == len(rows()) and all(r.difference == 0 for r in got)
    assert lm_score.cross_entropy_difference(frame(spark, []), frame(spark, [])).count() == 0


def test_lm_scores_count_every_word_and_bigram(spark):
    """More words than any table of fixed size, by ranks and, with few ranks, small blocks and many owners, by hashes."""
    r = random.Random(5)
    texts = [" ".join(f"w{int(50_000 * r.random() ** 2)}" for _ in range(150)) for _ in range(700)] + [" ".join(f"w{k}" for k in range(40_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    outside = [(None, "words w1 w2 that no document has"), (None, "w1 w2")]
    target = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame(outside, "doc_id long, text string"))
    models = BruteModels(list(enumerate(texts)), [(k, t) for k, t in enumerate(texts) if k % 3 == 0] + outside)
    want = {k: models.losses(k, t) for k, t in enumerate(texts)}
    for given in ({}, {"hot": 40, "dense": 9, "block": 3000, "owned": 5000}, {"hot": 40, "dense": 9, "block": 1000, "owned": 700, "fan": 3}):
        got = lm_score.cross_entropy_difference(docs, target, **given).collect()
        assert len(got) == len(texts)
        for x in got:
            assert x.n_words == len(texts[x.doc_id].split())
            assert math.isclose(x.target_loss, want[x.doc_id][0], rel_tol=1e-9) and math.isclose(x.background_loss, want[x.doc_id][1], rel_tol=1e-9)


def test_lm_messages_grow_with_the_corpus(spark, monkeypatch):
    """Sixteen times the words: each hop has about sixteen times the messages, and hops grow with the logarithm."""
    sizes = []
    kept = lm_score.written
    monkeypatch.setattr(lm_score, "written", lambda df, name, **k: sizes.append((name, kept(df, name, **k))) or sizes[-1][1])
    totals = []
    for n in (100, 1600):
        r = random.Random(n)
        texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        lm_score.cross_entropy_difference(docs, docs.where("doc_id < 5"), hot=40, dense=9, block=600, owned=600, fan=4)
        totals.append([df.count() for name, df in sizes if name == "messages"])
        sizes.clear()
    # 10 and 160 owners are 2 and 4 hops by fours; the last hop's messages are not written
    assert len(totals[0]) == 1 and len(totals[1]) == 3
    assert max(totals[1]) <= 20 * totals[0][0]


def test_lm_scores_tell_texts_that_occur_twice(spark):
    """A copy foresees a text; a text's own words do not."""
    r = random.Random(2)
    texts = [" ".join(f"w{int(500 * r.random() ** 2)}" for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    got = {x.doc_id: x for x in lm_score.cross_entropy_difference(docs, docs.where("doc_id between 40 and 60")).collect()}
    twice, once = [got[k].difference for k in [*range(5), *range(80, 85)]], [got[k].difference for k in range(5, 80)]
    assert min(twice) > max(once)
    assert abs(np.mean([got[k].difference for k in range(40, 61)]) - np.mean([got[k].difference for k in range(5, 40)])) < 0.1


def test_frequent_rows_of_one_count_are_split(spark):
    counted = spark.range(5000).selectExpr("cast(id as string) as word", "if(id < 10, 900L, 7L) as n")
    for most in (4, 1000, 5000):
        got = [r.word for r in frequent(counted, most).collect()]
        assert most * 0.9 - 5 <= len(got) <= most and (most < 10 or {str(k) for k in range(10)} <= set(got))
    assert frequent(counted.where("n = 7"), 1000).count() > 900


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    from .test_duplicates import brute, squeeze

    docs, labels, _ = labelled(spark, 300)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        was, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = ([tuple(r) for r in was.collect()], [tuple(r) for r in now.collect()])
        if name != "packing":
            assert now.columns == columns
    was, got = seen["exact dedup"]
    assert sorted(squeeze(r[1]) for r in got) == sorted({squeeze(r[1]) for r in was})
    was, got = seen["near dedup"]
    assert {r[0] for r in got if r[0] is not None} == {d for d, _, c in brute(was, 5, 80) if d is not None and d == c}
    was, got = seen["packing"]
    lengths = Counter()
    for p in got:
        lengths[p[5]] += p[2]
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())
    assert sum(lengths.values()) == sum(len(corpus_tokens(r[1])) + 1 for r in was)


def corpus_tokens(text):
    from meridia.llm.queries import tokenizer
    from meridia.llm.tokenize import load

    return load(tokenizer("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids



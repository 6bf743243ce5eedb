import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from meridia.llm import common, exact_dedup, near_dedup
from meridia.llm.components import components

from .cases import SCHEMA, frame, rows


def squeeze(text):
    out, run = [], False
    for c in text or "":
        space = c in " \t\n\x0b\x0c\r"
        if not (space and run):
            out.append(" " if space else c)
        run = space
    return "".join(out)


def copies():
    data = [list(r) for r in rows()]
    for k, source in enumerate((1, 1, 5, 60, 61), 200):
        data.append([k, *data[source][1:]])
    data.append([300, data[2][1].replace(" ", "\t \n", 3), *data[2][2:]])
    data += [[400 + k, "one hot text", *data[2][2:]] for k in range(40)]
    return [tuple(r) for r in data]


def test_exact_groups_against_brute_force(spark):
    import hashlib

    data = copies()
    by = defaultdict(list)
    for r in data:
        by[squeeze(r[1])].append(r[0])
    got = exact_dedup.groups(frame(spark, data)).collect()
    assert len(got) == len(data)
    want = Counter()
    for text, ids in by.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, least, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_first_copies_keep_columns(spark):
    data = copies()
    kept = exact_dedup.first_copies(frame(spark, data))
    assert kept.columns == frame(spark).columns
    got = kept.collect()
    assert sorted(squeeze(r.text) for r in got) == sorted({squeeze(r[1]) for r in data})
    assert {r.doc_id for r in got} >= {0, 1, 2, 5, 100, 107, 400}


def test_more_suspects_than_a_filter_holds(spark, monkeypatch):
    """Suspects are joined then, with the same results."""
    data = copies()
    want = Counter(exact_dedup.groups(frame(spark, data)).collect())
    near = brute(varied(7, 4, 10), 2, 80)
    monkeypatch.setattr(exact_dedup, "MOST_SUSPECTS", 2)
    assert Counter(exact_dedup.groups(frame(spark, data)).collect()) == want
    assert exact_dedup.first_copies(frame(spark, data)).count() == len({squeeze(r[1]) for r in data})
    got = near_dedup.near_duplicates(frame(spark, varied(7, 4, 10)), 2, 0.8).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near


def test_fingerprint_messages_grow_with_the_table(spark, monkeypatch):
    """Sixteen times the fingerprints, the same suspects as a count gives, and about sixteen times the messages."""
    monkeypatch.setattr(exact_dedup, "OWNED", 64)
    monkeypatch.setattr(exact_dedup, "FAN", 4)
    sizes = []
    kept = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, name, **k: sizes.append((name, kept(df, name, **k))) or sizes[-1][1])
    for n, parts in ((4096, 16), (65536, 256)):
        prints = spark.range(0, n, 1, parts).select(F.xxhash64(F.when(F.col("id") % 9 == 0, F.col("id") % 810).otherwise(F.col("id"))).alias("fp"))
        want = {r.fp for r in prints.groupBy("fp").count().where("count > 1").collect()}
        assert {r.fp for r in exact_dedup.suspect_fingerprints(prints, n).collect()} == want
    few, many = (df.count() for name, df in sizes if name == "fingerprints")
    assert many <= 20 * few
    assert common.fan_out(200, 256) == (200, 1) and common.fan_out(257, 256) == (289, 2) and common.fan_out(10**6, 256) == (10**6, 3)


def test_only_suspects_are_shuffled(spark):
    """Rows that the exchange clears go from the scan to the result."""
    plan = exact_dedup.groups(frame(spark, [*rows()]))._jdf.queryExecution().optimizedPlan().toString()
    told, clear = plan.split("\n+- ")  # the two sides of the union
    assert "Join" in told and "NOT" in clear and "Join" not in clear and "Aggregate" not in clear


def test_golomb_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(x)), x)
    x = np.arange(500, dtype=np.uint64)
    assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(x)), x)


def brute(data, width, percent):
    def low(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = []
    for r in data:
        words = [w for w in squeeze(low(r[1])).split(" ") if w]
        n = len(words)
        sets.append({tuple(words[k : k + width]) for k in range(max(1, n - width + 1))} if n else set())
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(data))


def varied(seed=5, groups=12, each=14):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    data = list(copies())
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice((6, 30, 120)))]
        for k in range(each):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                text[r.randrange(len(text))] = r.choice(words)
            data.append((1000 + g * 100 + k, " ".join(text).title(), "en", "src1", 1, 1, 2, 3, 4, 0.5))
    return data


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    data = varied()
    got = near_dedup.near_duplicates(frame(spark, data), width, 0.8)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(data, width, 80)


def test_near_duplicates_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 8)
    data = varied(6, 4, 30)
    got = near_dedup.near_duplicates(frame(spark, data), 2, 0.8)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(data, 2, 80)


def of_template(n, seed=8, own=18):
    """Documents of one template, at about 0.6 of each other; each tenth has a near copy at 0.8 or more."""
    r = random.Random(seed)
    template = [f"t{k}" for k in range(60)]
    data = []
    for k in range(n):
        text = template + [f"o{r.randrange(10 * n)}" for _ in range(own + r.randrange(6))]
        data.append((k, " ".join(text), "en", "src1", 1, 1, 2, 3, 4, 0.5))
        if k % 10 == 0:
            text[r.randrange(60, len(text))] = "other"
            data.append((100_000 + k, " ".join(text), "en", "src1", 1, 1, 2, 3, 4, 0.5))
    return data


def test_template_is_compared_in_few_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    seen = {}

    def noted(df, name, even=True):
        table = common.written(df, name, even)
        if name in ("cells", "first-shingles"):
            seen.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "written", noted)
    for n in (150, 600):
        data = of_template(n)
        got = near_dedup.near_duplicates(frame(spark, data), 2, 0.8)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(data, 2, 80)
    cells, dealt = seen["cells"], seen["first-shingles"]
    assert len(dealt) == 2
    assert cells[1] < 4**1.1 * cells[0]


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_first_shingles_meet(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(3000):
        both = rng.integers(1, 60)
        x, y = (np.unique(np.r_[np.arange(both), 1000 * k + rng.integers(100, 900, rng.integers(0, 8))]) for k in (1, 2))
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        rarity = rng.integers(0, 3, 4000)
        (of_x, short), (of_y, _) = (near_dedup.first_shingles(v, rarity[v], percent) for v in (x, y))
        assert set(x[of_x][:short]) & set(y[of_y])
        met += 1
    assert met > 100


def test_one_of_each(spark):
    data = varied(7, 4, 10)
    got = near_dedup.one_of_each(frame(spark, data)).collect()
    want = brute(data, 5, 80)
    assert {r.doc_id for r in got if r.doc_id is not None} == {d for d, n, c in want if d == c and d is not None}
    assert len([r for r in got if r.doc_id == 107]) == 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.first_copies(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.one_of_each(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, k) for k in range(201, 230)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100, **{k: 200 for k in range(201, 230)}}


def test_sketches_estimate_differences():
    r = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    for _ in range(20):
        a = [r.choice(words) for _ in range(400)]
        b = a[:]
        for _ in range(18):
            b[r.randrange(400)] = r.choice(words)
        x, y = (near_dedup.shingles(" ".join(t), 2) for t in (a, b))
        common = len(np.intersect1d(x, y))
        s, t = (near_dedup.odd_sketch(near_dedup.minhash(v)).view(np.uint64) for v in (x, y))
        assert common / (len(x) + len(y) - common) > 0.8
        assert np.bitwise_count(s ^ t).sum() <= near_dedup.reach(0.8)

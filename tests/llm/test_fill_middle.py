"""Fill-in-middle against a version that holds arrays of units."""

import hashlib
import re
from collections import Counter

from meridia.llm import fill_middle

from .cases import SCHEMA, frame, rows

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def cases():
    """The awkward rows, texts with marks whole, in part and split over the cuts, and code points beyond the first plane."""
    more = ["<P>", "a <S> b", "<M", "<P<S", "<<S>>", "P>S>M>", "<" * 50, "<P" * 40, ">" * 9, "𝕏a𝕏b" * 7, "\n", "a", "\r\nb c", "é" * 3]
    return rows() + [(200 + k, t, "en", "s", 1, 1, 1, 1, 1, 0.5) for k, t in enumerate(more * 12)]


def test_fill_in_middle(spark):
    want = Counter(expected(r[0], r[1]) for r in cases())
    done = fill_middle.fill_in_middle(frame(spark, cases()))
    assert Counter(tuple(r) for r in done.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_texts_are_rebuilt_from_outputs(spark):
    got = fill_middle.digests(fill_middle.fill_in_middle(frame(spark, cases())))
    texts = Counter((r[0], sha(r[1] or ""), sha(expected(r[0], r[1])[5])) for r in cases())
    assert Counter((r.doc_id, r.restored_sha256, r.output_sha256) for r in got.collect()) == texts


def test_shares(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('ab c', id) as text")
    count = lambda **k: Counter(r.form for r in fill_middle.fill_in_middle(docs, **k).collect())
    assert count(plain_share=100) == {"plain": 400} and count(plain_share=0, spm_share=100) == {"spm": 400}
    assert count(plain_share=0, spm_share=0) == {"psm": 400} and 0 < count()["spm"] < count()["psm"]


def test_cut_stops_at_both_ranks():
    text = "ab, c1 " * 4
    units = re.findall(fill_middle.UNIT, text)
    for first in range(len(units) + 1):
        for second in range(len(units) + 1):
            n, low, high = fill_middle.cut(text, first, second)
            assert n == len(units)
            assert (low, high) == (len("".join(units[: min(first, second)])), len("".join(units[: max(first, second)])))


def test_empty_table(spark):
    assert fill_middle.digests(fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []

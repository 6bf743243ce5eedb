"""Fill-in-middle: a two-pass streaming matcher that never holds an array of units.

Units are runs of ASCII letters and single other code points. The first pass over a text counts them. Two hashes of the document's
id give the ranks where prefix and middle end; the second pass advances a lazy iterator of matches to the smaller rank, notes where
it stands, goes on to the larger one and stops there. A task holds one text and two positions besides. Ids, ranks, forms and the
rebuilt texts are column expressions.

Forms: plain leaves a text as it is: an empty one, one that holds a mark, and the share of documents that plain_share gives. Of the
others a share of spm_share goes out suffix first (spm), the rest prefix first (psm).

Null text counts as empty. A null doc_id hashes as the empty string. Repeated rows and equal ids each give a row of their own; equal
rows give equal results. An empty table gives no row. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ADDED = [("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Units of text, and the code points where prefix and middle end; the two hashes are reduced by one more than the units."""
    matches = re.compile(UNIT).finditer
    n = sum(map(bool, matches(text)))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    units, at = matches(text), []
    for steps in (low, high - low):
        last = next(islice(units, steps - 1, None)) if steps else None
        at.append(last.end() if last else at[-1] if at else 0)
    return n, at[0], at[1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], []]
        for text, form, first, second in zip(*(batch.column(c) for c in ("text", "form", "first", "second"))):
            n, low, high = cut(text.as_py(), first.as_py(), second.as_py())
            split = form.as_py() != PLAIN
            for column, value in zip(columns, (n, low if split else None, high - low if split else None)):
                column.append(value)
        made = [pa.array(c, t) for c, (_, t) in zip(columns, _ADDED)]
        kept = ["doc_id", "text", "form"]
        yield pa.record_batch([*(batch.column(c) for c in kept), *made], [*kept, *(name for name, _ in _ADDED)])


def _group(digest: Column, k: int) -> Column:
    """The k-th eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points, null if plain) and output of each document; shares in hundredths."""
    docs = documents_of(documents)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    plain = (F.col("text") == "") | (F.pmod(_group(F.col("digest"), 2), F.lit(100)) >= 100 - plain_share)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.col("text").contains(mark)
    form = F.when(plain, PLAIN).when(F.pmod(_group(F.col("digest"), 3), F.lit(100)) < spm_share, SPM).otherwise(PSM)
    ranked = docs.withColumn("digest", digest).select(
        "doc_id", "text", form.alias("form"), _group(F.col("digest"), 0).alias("first"), _group(F.col("digest"), 1).alias("second")
    )
    parted = ranked.mapInArrow(_cut, "doc_id long, text string, form string, n long, prefix_chars long, middle_chars long")
    text, before = F.col("text"), F.col("prefix_chars") + F.col("middle_chars")
    prefix = text.substr(F.lit(1), F.col("prefix_chars").cast("int"))
    middle = text.substr((F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int"))
    suffix = text.substr((before + 1).cast("int"), F.length(text))
    output = (
        F.when(F.col("form") == PLAIN, text)
        .when(F.col("form") == PSM, F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return parted.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def _between(text: Column, left: str, right: str | None) -> Column:
    """What lies between two marks; a text that is split holds none itself, so the first of each is the mark."""
    start = F.locate(left, text) + len(left)
    return text.substr(start, (F.locate(right, text) if right else F.length(text) + 1) - start)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    psm = F.concat(_between(output, PREFIX, SUFFIX), _between(output, MIDDLE, None), _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), _between(output, MIDDLE, None), _between(output, SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """The columns of fill_in_middle, with SHA-256 in lower-case hexadecimal for the output and for the text rebuilt from it."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )

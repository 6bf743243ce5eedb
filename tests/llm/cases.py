"""Small documents with the awkward cases, for all operators on documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, key long, size long, part long, n double"


def rows(n: int = 60, seed: int = 3):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    r = random.Random(seed)
    words = ["the", "Of", "and", "tion", "idiot", "x1", "über", "naïve", "don't", "STOP!!", "a,", "b.\n", "<|endoftext|>"]
    out = []
    for k in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 40)))
        out.append((k, text, "en", f"src{k % 3}", len(text), 1, 2, 3, 4, 0.5))
    out += [
        (100, None, None, None, None, None, None, None, None, None),
        (101, "", "en", "src1", 0, 1, 2, 3, 4, 0.5),
        (102, " \t\n ", "en", None, 4, 1, 2, 3, 4, 0.5),
        (103, "word " * 30_000, "en", "src2", 150_000, 1, 2, 3, 4, 0.5),
        (104, "x" * 50_000, "en", "src2", 50_000, 1, 2, 3, 4, 0.5),
        (105, "a  b\n\n  c\x1fd e　f    g\r\n", "fr", "src2", 9, 1, 2, 3, 4, 0.5),
        (106, "The END İstanbul ΣΑΣ ﬁ 𝕏 <|startoftext|> <|ENDOFTEXT|> é", "fr", "src2", 9, 1, 2, 3, 4, 0.5),
        (None, "no id at all", "en", "src0", 3, 1, 2, 3, 4, 0.5),
        (None, None, None, None, None, None, None, None, None, None),
        (107, "twice the same row", "en", "src0", 3, 1, 2, 3, 4, 0.5),
        (107, "twice the same row", "en", "src0", 3, 1, 2, 3, 4, 0.5),
    ]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)

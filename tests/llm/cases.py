"""Small tables that hold the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make or use inside, as columns of the input.
EXTRA = ("text_crc32", "shard", "slot", "score", "fp", "k", "size", "start", "base", "all", "told", "hash", "contaminated", "__key", "__text", "quota", "target", "rank", "n", "ids", "part", "id1")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega Äpfel über ça".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([".", ",", "!\n", ""]) if r.random() < 0.2 else "") for _ in range(n))


def rows(seed: int = 0) -> list[tuple]:
    long = prose(seed + 77, 40_000)
    texts = [None, "", "   \t\n", "a", "A b C", "a b c d", "a b c d e", long, prose(seed + 1, 200), prose(seed + 1, 200), prose(seed + 2, 300), prose(seed + 3, 25), "x" * 30_000, "é" * 500 + " ß", "\u0000 nul \u0085   end", "🙂 emoji 🙂 text"]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    near = prose(seed + 2, 300).split(" ")
    near[150] = "changed"
    out.append((100, " ".join(near), "en", "src1", 0))
    out += [out[8], out[8], (None, "no id here", None, None, None), (None, None, None, None, None), (5, "a b c d", "en", "src0", 7), (-7, "negative id", "xx", "é", 1)]
    return out


def documents(spark, seed: int = 0, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(seed), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in EXTRA}) if clash else df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(df, other) -> bool:
    return sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r) for r in other.collect())))

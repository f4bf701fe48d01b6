"""Small fixtures and plain versions of what the operators compute."""

from __future__ import annotations

import random

WORDS = "the of and river stone cold light under spring märz été 12 x-ray it's don't A.B. 你好 ½ Ⅷ".split()


def texts(n: int, seed: int = 3) -> list[str | None]:
    """Texts with copies, near copies, repeats, odd blanks, empty ones and nulls."""
    draw = random.Random(seed)
    out: list[str | None] = [None, "", " \t\n", "one", "two words", "<|endoftext|> and <|startoftext|>the", "a\x1cb\x85c", "ΟΔΟΣ Σ", "été"]
    while len(out) < n:
        text = " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", ".\n"]) for _ in range(draw.randint(3, 90)))
        out.append(text)
        if draw.random() < 0.2:
            out.append(text)
        if draw.random() < 0.2:
            out.append(text + " " + draw.choice(WORDS))
        if draw.random() < 0.1:
            out.append("\n".join([text] * 3))
    out.append("long " * 30_000)
    return out[:n] + out[-1:]


def frame(spark, rows: list[tuple], schema: str, folder: str | None = None):
    """A frame of the rows; through Parquet files where a folder is given."""
    df = spark.createDataFrame(rows, schema)
    if folder:
        df.repartition(3).write.mode("overwrite").parquet(f"{folder}/table")
        df = spark.read.parquet(f"{folder}/table")
    return df


def documents(spark, n: int = 60, folder: str | None = None):
    """Documents with a null id, repeated rows, a null source and columns whose names the operators use inside."""
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), -1, "x") for i, t in enumerate(texts(n))]
    rows += [(None, "no id here", "en", "s1", 10, 0, "y"), rows[7], rows[7]]
    return rows, frame(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, digest string", folder)


def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, digest string")

"""Small corpora with the awkward cases: nulls, empties, ties, repeats, long and
odd texts, and columns whose names clash with those the operators use."""

import random

WORDS = [a + b for a in ("al", "be", "ga", "de", "ep", "ze") for b in ("pha", "ta", "mma", "lta", "silon", "Ä", "xi")]


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 3):
        words = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 90))]
        texts.append(" ".join(words))
        copy = list(words)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
        texts.append(rng.choice(texts))
    texts += [None, None, "", " \t\n", "a", "A", "a b", "Ä", "ä", "x" * 7000, "x" * 7001, ("lorem ipsum " * 3000) + "end", "line\nline\n\nline\n"]
    return [(i * 7 % 1009, t, f"src{i % 4}" if i % 11 else None) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def clashing(spark, rows):
    """The same rows with columns that operators use inside."""
    df = frame(spark, rows)
    for name in ("_key", "_text", "_rid", "node", "sig", "size", "slot", "block", "n", "root", "_k", "_place", "_bucket", "token_ids", "text_sha256", "name", "__raw", "__placed", "__place", "__gone_key"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(1))
    return df


def table(df, tmp_path, name="docs"):
    """Operators read their input several times, so they take tables."""
    path = str(tmp_path / name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

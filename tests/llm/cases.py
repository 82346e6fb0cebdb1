"""Small tables with the awkward cases every operator must stand."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"Shared{i} passage{i * 7 % 31}" for i in range(40))


def documents(seed: int = 3, n: int = 120) -> list[tuple]:
    """Null and empty texts, a very long one, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "Ne", "pu", "é", "ß") for b in ("ra", "si", "to", "un", "x", ".")]

    def prose(k: int) -> str:
        return " ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.7 else "") +
                        ("\n" if rng.random() < 0.1 else "") for _ in range(k))

    rows: list[tuple] = [(0, None, "en", "src0", None), (1, "", None, None, 0), (2, " \t\n", "en", None, 3),
                         (3, "one two", "en", "src1", 7), (4, "tail" * 9000, "en", "src0", 36000),
                         (5, prose(30000), "fr", "src2", 1), (6, "\n\n a \n", None, "src1", 6)]
    base = [prose(rng.randint(60, 160)) for _ in range(8)]
    for i in range(7, n):
        kind, text = i % 6, rng.choice(base)
        if kind == 1:
            ws = text.split(" ")
            for _ in range(rng.randint(1, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            text = " ".join(ws)
        elif kind == 2:
            text = prose(rng.randint(20, 60)) + " " + PASSAGE + " " + prose(rng.randint(20, 60))
        elif kind >= 3:
            text = prose(rng.randint(1, 120)) + "\nAll rights reserved \n"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", None]), len(text)))
    rows.append(rows[20])
    return rows


def frame(spark, rows, schema: str = DOC_SCHEMA, parts: int = 4):
    return spark.createDataFrame(rows, schema).repartition(parts)


def saved(spark, folder, rows) -> str:
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)

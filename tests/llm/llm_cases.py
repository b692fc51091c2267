from __future__ import annotations

import random

WORDS = (
    "the of and der la is river stone market garden winter letter window silver forest engine paper shadow"
    " bridge copper island summer mirror candle harbor meadow thunder castle orange basket feather"
).split()
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, key bigint,"
    " text_sha256 string, tokens int, weight double, signature string, component_id int, a int, label int"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n)]
    return " ".join(w + ("\n" if i % 12 == 11 else "") for i, w in enumerate(out))


def make_docs(spark, rows):
    """Documents from (doc_id, text, ...) with columns whose names clash with inner ones."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, "en", "s0")[:4] if len(row) < 4 else row[:4]
        full.append((doc_id, text, lang, source, None, "x", 1, "y", 2, 0.5, "z", 3, 4, 5))
    return spark.createDataFrame(full, SCHEMA).repartition(3)

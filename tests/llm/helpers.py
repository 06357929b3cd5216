"""Shared odd documents: nulls, empties, repeats, ties, very long texts and columns with clashing names."""

import random

CLASHES = "rep version digest bands doc x hi lo starts ends moves group anchor"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("bak dol fem gir hup jat kel mon nif pos rut saw tib vex wun yag zed".split()) + r.choice("a e i o u an en in".split()) + str(r.randint(0, 9) or "") for _ in range(n)]


def frame(spark, rows):
    """rows of (doc_id, text), with extra columns named as the operators' inner ones."""
    extra = CLASHES.split()
    return spark.createDataFrame([(i, t, *("clash",) * len(extra)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))


def odd_rows():
    long = " ".join(words(12_000, 1))
    return [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "  \n "), (6, long), (7, long), (8, "x" * 3000), (9, "é ñ 中文 \U0001f600 ß"), (9, "é ñ 中文 \U0001f600 ß"), (None, "no id here at all"), (10, "tie tie tie tie")]

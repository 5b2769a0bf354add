"""Small awkward documents."""

import random

SCHEMA = "doc_id long, text string, Quality string, n_chars long"


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Copies, near copies, repeats, nulls, empty and long texts, repeated rows and a null id; with a clashing column name."""
    rng = random.Random(seed)
    words = [("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(60)
    base = text(120)
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = base
        elif kind == 1:
            parts = base.split(" ")
            for _ in range(rng.randint(1, 9)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            t = " ".join(parts)
        elif kind == 2:
            t = text(30) + "\n" + passage + "\n" + text(20)
        elif kind == 3:
            t = (text(3) + " ") * 40
        elif kind == 4:
            t = text(rng.randint(1, 4))
        elif kind == 5:
            t = "\n".join([text(6)] * 5 + ["", " ", text(7)])
        else:
            t = text(rng.randint(20, 300))
        out.append((i, t))
    out += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, text(9000)), (1004, "x"), (1005, "x"), (None, text(50)), (7, out[7][1]), (7, out[7][1]), (1006, "a" * 5000), (1007, "ab" * 300 + " " + "ab" * 300)]
    return [(i, t, "q", len(t or "")) for i, t in out]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)

"""Small documents: copies, near copies, shared passages, personal data, nulls, empty and repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, score string, bucket string"


def documents(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ñandú", "the", "a"]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = some(60), some(120)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = base[:]
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            texts.append(" ".join(w))
        elif kind == 1:
            texts.append(" ".join(some(rng.randrange(60)) + passage + some(rng.randrange(60))))
        elif kind == 2:
            texts.append("\n".join(" ".join(some(8)) for _ in range(rng.randrange(1, 30))))
        elif kind == 3:
            texts.append(" ".join(base).upper())
        elif kind == 4:
            texts.append(f"mail me at joe.{i}@mail.example.org or +44 20 7946 {1000 + i} from 10.0.{i}.7 card 4111 1111 1111 1111 " + " ".join(some(50)))
        else:
            texts.append(rng.choice(["", " \n\t", "one two", "x" * 5000, "same line\nsame line\nsame line", " ".join(some(2500))]))
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t), 1, "h", "s", "b") for i, t in enumerate(texts)]
    rows += [(None, "a null id", "en", "s0", 9, 1, "h", "s", "b"), (n, None, None, None, None, None, None, None, None), rows[0], rows[0]]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def labels(spark, rows):
    known = [(r[0], int(len((r[1] or "").split()) > 60), 0) for r in rows if r[0] is not None]
    return spark.createDataFrame([*known, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")

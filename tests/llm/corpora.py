"""Small corpora that hold every hard case."""

import random

WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "ñu", "xi", "omicron", "rho", "sigma", "tau", "Upsilon", "phi", "chi", "psi"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def corpus(seed=1, n=120):
    """(doc_id, text) with copies, near copies, shared passages and lines, nulls, empties, odd spaces and a long text."""
    rng = random.Random(seed)
    passage, line = prose(rng, 60), "  A common footer line of this site "
    texts = []
    for i in range(n):
        kind = i % 12
        if kind == 0 and texts:
            texts.append(rng.choice([t for t in texts if t] or [""]))
        elif kind in (1, 2) and i > 12:
            words = (texts[3] or "").split(" ")
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(999)}"
            texts.append(" ".join(words))
        elif kind == 5:
            texts.append(f"{prose(rng, 20)}\n{line}\n{passage}\n\n{prose(rng, 9)}")
        elif kind == 7:
            texts.append(f"{prose(rng, 15)}\t\r\n{line.lower()}\n{prose(rng, 8)} ")
        elif kind == 9:
            texts.append(rng.choice([None, "", " \n\t ", "one", "two words", "\n\n"]))
        else:
            texts.append(prose(rng, rng.choice([5, 30, 90, 200])))
    texts.append(prose(rng, 3000))
    texts.append("ab " * 700)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows, extra=False):
    """documents; extra: columns with the names that operators use inside."""
    if extra:
        names = ["n", "size", "key", "shard", "slot", "kept", "tokens", "all", "first", "doc", "lost", "gone", "dirty", "sketch", "copy"]
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or ""), *[None] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    return spark.createDataFrame([(i, t, "en", [None, "b", "a", "c"][(i or 0) % 4], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

"""Documents with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long"
_SYLLABLES = {"en": ["the", "and", "ing", "her", "tion", "wh", "st", "ou"], "fr": ["eau", "ouè", "ment", "elle", "ré", "tion", "çon", "vi"]}


def words(rng, lang, n):
    return ["".join(rng.choice(_SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(rng, lang, n):
    w = words(rng, lang, n)
    return " ".join(w[i].capitalize() if i % 9 == 0 else w[i] + ("." if i % 9 == 8 else "") for i in range(n)) + ".\n"


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, and two columns whose names clash with results)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        rows.append([i, text(rng, lang, rng.choice([5, 60, 120, 300])), lang, f"src{i % 3}"])
    rows.append([n, rows[3][1], rows[3][2], "src0"])  # an exact copy
    near = rows[[k for k, r in enumerate(rows) if len(r[1]) > 1200][0]][1].split(" ")
    near[7] = "changed"
    rows.append([n + 1, " ".join(near), "en", "src1"])  # a near copy
    rows += [[n + 2, None, None, None], [n + 3, "", "en", "src0"], [n + 4, "   \n\t", "en", "src0"], [None, "no id at all here", "en", "src0"], [n + 5, "!!! ... 123", None, "src2"]]
    rows.append([n + 6, text(rng, "en", 30_000), "en", "src0"])  # very long
    rows.append(list(rows[5]))  # the same row again
    return [(*r, len(r[1]) if r[1] is not None else None, 0.5, 7) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)

"""Small texts with copies, near copies, passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, _text string, _key int, u long"
WORDS = {"en": "the of and to in is that for it was on with as by at from".split(), "fr": "le la les des une est dans pour que qui sur avec par au ce il".split(), "de": "der die das und ist nicht von zu mit den im auf ein eine für dem".split()}


def prose(rng, lang="en", n=120):
    stem = {"en": ["ing", "tion", "able", "ness", "ly"], "fr": ["eux", "ment", "ait", "é", "oir"], "de": ["ung", "keit", "lich", "schaft", "ß"]}[lang]
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) + rng.choice(stem) for _ in range(n))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    langs = ["en", "fr", "de"]
    base = [(prose(rng, langs[i % 3], rng.choice([3, 4, 5, 7, 12, 40, 90, 150, 400])), langs[i % 3]) for i in range(n)]
    passage = prose(rng, "en", 70)
    rows = []
    for text, lang in base:
        rows.append((text, lang))
        if rng.random() < 0.5:
            for _ in range(rng.randrange(1, 4)):
                rows.append((edited(rng, text, rng.randrange(0, 4)), lang))
    rows += [(prose(rng, "en", 50) + " " + passage + " " + prose(rng, "en", 60), "en") for _ in range(4)]
    rows += [("This work is CC BY 4.0. All rights reserved.\nGNU General Public License, version 3", "en"), ("cc-by cc by, ALL rights\treserved all rights reserved", "en")]
    return rows


ODD = [None, "", " \n\t ", "a", "Ä", "12 345", "the the the the the the the the", "\x00\x1f", "x" * 3000, "word " * 40_000, "日本語 テキスト", "a" * 500 + "b" + "a" * 500]


def documents(spark, seed=1, n=60):
    """Texts of `texts`, the odd ones, two equal rows, null ids, languages and sources, and columns with awkward names."""
    rows = [(i, t, lang, f"src{i % 3}", len(t), "m", "t", 1, 2) for i, (t, lang) in enumerate(texts(seed, n))]
    k = len(rows)
    rows += [(k + i, t, "en" if i % 2 else None, None if i % 3 else "odd", None, None, None, None, None) for i, t in enumerate(ODD)]
    rows += [rows[0], rows[0], (None, rows[3][1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

"""Documents with every awkward property at once, and the words rules written once more."""

import random
import re

import pytest

from reviewlake.llm import queries

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "n_words bigint, site string, lines int, row int, kept boolean, part int, doc bigint, gone int, kind string, _gone string")

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def solid_words(text):
    return SOLID.findall(text or "")


def make_texts(seed=3, n=60):
    """Random words with shared passages, near copies, repeats, licence wording and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeñüé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if i % 4 == 1:
            words[len(words) // 2:len(words) // 2] = passage.split()[rng.randint(0, 20):rng.randint(40, 60)]
        if i % 5 == 2:
            words.append(rng.choice(["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC", "mit\tlicense mit license"]))
        text = " ".join(words)
        if i % 7 == 3:
            text = "\n".join(text[k:k + 40] for k in range(0, len(text), 40))
        texts.append(text)
        if i % 6 == 0:  # a near copy: a few words changed
            copy = words[:]
            for _ in range(len(copy) // 20):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def make_rows():
    texts = [*make_texts(), "", " \n\t ", None, "x", "one two", "Ab " * 4000, "\n\n", "word\x00\x1f #*$%&|<> ñ", "same text here", "same text here"]
    texts.append(" ".join(t or "" for t in texts))  # long, and full of repeats
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), 1, "x", 2, 3, None, 4, 5, 6, "k", "g") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 13)]
    rows.append(rows[4])  # a row twice
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    texts = make_texts()
    cut = [" ".join(texts[k].split()[5:5 + n]) for k, n in ((1, 12), (5, 30), (9, 10), (13, 7), (17, 3), (21, 1))]
    data = [(i, t, "extra") for i, t in enumerate(cut)] + [(100, None, None), (101, "", None), (2, cut[2], None), (None, cut[0], None), (7, "no such words at all", None)]
    return spark.createDataFrame(data, "item_id bigint, text string, doc_id string")


@pytest.fixture(scope="session")
def answers():
    return queries

import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared passages, odd white space and every defined odd case."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abdeiklmnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(400)] + ["The", "Été", "naïve", "x|y", "#tag", "$5", "ok!!"]
    line = " ".join(rnd.choice(words) for _ in range(13))
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = []
    for i in range(60):
        body = [rnd.choice(words) for _ in range(rnd.randint(20, 160))]
        if i % 4 == 0:
            body[10:10] = passage.split()
        if i % 3 == 0:
            body[5:5] = line.split()
        texts.append(rnd.choice([" ", "\n", " \t"]).join(body))
    texts += [texts[3], texts[3], texts[7].replace(" ", "  ", 3)]
    near = texts[8].split()
    near[30] = "changed"
    texts.append(" ".join(near))
    texts += [None, "", " \n\t ", "one", "two words", "a b c d e", "Und " * 80, "MIT License\nApache License, GNU General Public License v3. cc-by", "\u00a0nbsp\u2003em", "日本 語", "x" * 5000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or ""), "clash") for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, hits string")


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)

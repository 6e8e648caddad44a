import random

import pytest

WORDS = "the of and to in that is was for with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(id, text) with copies, edits, shared passages, a very long text, empties and a null."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 400)) for _ in range(60)]
    passage = prose(rng, 80)
    rows = list(enumerate(base))
    for k in range(20):
        rows.append((100 + k, base[k]))
        words = base[k].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + k, " ".join(words)))
        rows.append((300 + k, f"{prose(rng, 30)} {passage}\n{prose(rng, 30)}"))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, prose(rng, 20000)), (405, "word " * 300), (406, "Größe ÉTÉ   日本語 \U0001f600 x"), (401, "")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns, one of which clashes with a column that operators make."""
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "mine", 7) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score int")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

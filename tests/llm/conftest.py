import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, fp long, id string, component double, spans int"


def texts(seed=5):
    """Documents with copies, shared passages, edges and null columns."""
    rng = random.Random(seed)
    words = [f"w{i}x{'é' if i % 7 == 0 else 'y'}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = say(60), say(45)
    out = [say(rng.randint(5, 120)) for _ in range(40)]
    out += [f"{say(10)} {passage} {say(8)}", f"{passage}\t{say(3)}", f"{say(4)} {other}\n{say(6)} {other}", other, "x " * 90, "x " * 90, "", "  \n ", "one", "One two", "one two", "a" * 130, "é" * 70, "é" * 70 + "z", say(4000)]
    out += [out[0], out[0], out[1] + " tail", out[2].upper()]
    return out


def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t), "c", i, "x", 0.5, 1) for i, t in enumerate(texts())]
    out += [(900, None, None, None, None, None, None, None, None, None), (901, None, "en", "s1", 0, "c", 1, "x", 0.5, 1)]
    out += [(None, texts()[0], None, None, 1, "c", 1, "x", 0.5, 1), (None, "lonely null id", None, None, 1, "c", 1, "x", 0.5, 1)]
    out += [out[3], out[3], (out[5][0], "the same id with another text", "en", "s0", 1, "c", 1, "x", 0.5, 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)

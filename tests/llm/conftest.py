import pytest

WORDS = "the of and to in is that it was for on are with as at by this be from or have an they which one you were all her she there would their".split()


@pytest.fixture(scope="session")
def texts():
    """Deterministic documents: plain, repeated, empty, white, null, long and odd ones."""
    import random

    draw = random.Random(4)
    plain = [" ".join(draw.choices(WORDS, k=draw.randint(12, 60))) for _ in range(60)]
    odd = ["", " \n\t ", None, "a", "Ünï ç\n\n日本語 🙂 don't <|endoftext|> x", "same line\nsame line\nother", "w " * 30000, "z" * 5000, plain[0], plain[0], plain[1] + " extra"]
    return plain + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

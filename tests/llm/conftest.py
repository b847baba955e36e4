import random

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, blanks, repeats, ties, a very long text, and columns whose names clash with results."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    vocabulary = [word(rng.randint(1, 6)) for _ in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = line(60)
    texts = [None, "", "   \n\t ", "x", "x " * 400, "same text here", "same text here", shared, f"{line(30)} {shared} {line(30)}", f"{shared}\n{line(10)}", " ".join(line(50) for _ in range(300))]
    texts += [line(rng.randint(1, 120)) for _ in range(25)] + [line(40).upper(), "tab\tand\x0bvertical \x85 odd blank", "<|endoftext|> 's don't", "日本語テキスト " * 20, "a" * 3000]
    rows = [(n if n != 4 else None, t, "en", f"src{n % 3}", len(t or ""), n, "clash") for n, t in enumerate(texts)] + [(7, shared, "en", "src1", 9, 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)

"""Small tables with the cases every job must take: nulls, empty, long and repeated texts, ties, extra columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, bits string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * (seed % 5 + 1) + k * k) % len(WORDS)] for k in range(n))


def odd_documents(spark):
    """Rows every job is run on; the last columns clash with names the jobs use."""
    texts = [
        None, "", " \t\n", "one", "two words", sentence(1, 40), sentence(1, 40), sentence(1, 39) + " changed",
        sentence(2, 6000), "Ünïcode  wörds and\x1cmarks 日本語 😀 İΣ", "<|endoftext|> it's <|startoftext|>don't", "a" * 5000,
        sentence(3, 60), sentence(4, 60), sentence(4, 60).upper(),
    ]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or ""), 0.5, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", "en", "s1", 5, None, None, None), (-3, sentence(5, 30), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)

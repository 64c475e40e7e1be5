import pytest


@pytest.fixture(scope="session")
def docs_table(spark):
    """A small table of documents with edge rows: nulls, empty and one-word texts, copies, a long text, a repeated row, clashing columns."""
    words = "the cat sat on a mat and then it ran to the old red barn where nine hens slept near warm hay".split()
    text = " ".join(words * 3)
    near = text.replace("barn", "shed", 1)
    rows = [
        (1, text, "en"), (2, text, "en"), (3, near, "en"), (4, None, "en"), (5, "", None), (6, "Hello", "en"),
        (7, "hello", "de"), (8, "le chat est sur la table et la souris aussi " * 6, "fr"), (9, "der hund und die katze sind im haus " * 6, "de"),
        (10, "x " * 50_000, "en"), (11, "12345 !!! ...", "en"), (None, "a row without an id has words too", "en"), (3, near, "en"),
        (12, "漢字 かな " * 20, "en"), (13, " \t\n", "en"),
    ]
    rows = [(i, t, lang, "src", len(t or ""), "s", 1.0, "p") for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred double, row string")

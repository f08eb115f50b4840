"""Typo expansion of long and of known words."""

from placeloom.operators import search


def test_typos_two_edits_for_long_words_and_only_commoner(spark):
    """q13: two edits from seven letters on, adjacent swaps among them; a known word has commoner ones only."""
    vocabulary = spark.createDataFrame([("hijejeton", 5), ("garden", 9), ("gardens", 2), ("lane", 7), ("line", 8), ("lanes", 1)], "term string, n long")
    words = spark.createDataFrame([(w,) for w in ("hijjeeton", "hijexexon", "hijxxxton", "garedn", "gardens", "lane", "lanex")], "word string")
    got = {(r.word, r.correction) for r in search.typo_expansion(words, vocabulary).collect()}
    assert got == {("hijjeeton", "hijejeton"), ("hijexexon", "hijejeton"), ("gardens", "garden"), ("lane", "line"), ("lanex", "lane"), ("lanex", "lanes")}

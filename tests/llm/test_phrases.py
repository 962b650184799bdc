"""Phrases of the de Bruijn graph against counting every gram."""

import re
from collections import Counter

import pytest

from revlens.llm import phrases

ROWS = [
    ("red hot chili peppers, red hot chili peppers; red hot", "en"), ("Red HOT chili\tpeppers  and a a a a a a", "en"), (None, "en"), ("", "en"),
    (" . , ;\n", None), ("no language here: no language here", None), ("word " * 3000, "xx"), ("a b c d e f g h\x0bi\x00j k", "t\tab"),
    ("ÄÖ straße   x  y", "de"), ("ÄÖ straße   x  y", "de"), ("x" * 50_000, "de"), ("tail of a piece", "en"), ("tail of a piece", "en"),
]


def brute(rows, longest, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda found: found[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for width in range(1, longest + 1):
                counts.update((lang, *words[k : k + width]) for k in range(len(words) - width + 1))
    candidates = {gram: a for gram, a in counts.items() if len(gram) > 2 and a >= least}
    covered = {(long[0], *long[k : k + width]) for long, f in candidates.items() for width in range(2, len(long) - 1)
               for k in range(1, len(long) - width + 1) if 100 * f >= 50 * counts[(long[0], *long[k : k + width])]}
    by_lang = {}
    for gram in candidates.keys() - covered:
        a, cuts = candidates[gram], []
        for k in range(2, len(gram)):
            left, right = counts[gram[:k]], counts[(gram[0], *gram[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang.setdefault(gram[0], []).append((-score, -a, " ".join(gram[1:]).encode(), left, right))
    return sorted((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score) for lang, found in by_lang.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1))


def table(spark, rows):
    return spark.createDataFrame([(text, lang, 1, "p", 2) for text, lang in rows], "text string, lang string, level int, phrase string, count int").repartition(3)


@pytest.mark.parametrize("longest,least,top", [(3, 2, 2000), (4, 2, 5), (2, 1, 2000)])
def test_phrases_equal_counted_grams(spark, longest, least, top):
    found = phrases.collocations(table(spark, ROWS), longest=longest, least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(ROWS, longest, least, top)


def test_blocks_and_copies_change_nothing(spark):
    rows = ROWS * 4
    grams = phrases.frequent_grams(table(spark, rows), least=3, block_words=50).filter("level > 0")
    counts = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda found: found[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            counts.update(("und" if lang is None else lang, " ".join(words[k : k + width])) for width in (1, 2, 3) for k in range(len(words) - width + 1))
    assert {(row["lang"], row["phrase"]): row["count"] for row in grams.collect()} == {gram: count for gram, count in counts.items() if count >= 3}


def test_paths_join_edges_of_one_way(spark):
    rows = [("one two three four five six", "en")] * 2 + [("zero two three four nine", "en")] * 3
    edges = phrases.graph_edges(phrases.frequent_grams(table(spark, rows), least=2))
    found = {(row["words"], row["edges"], row["count"]) for row in phrases.path_texts(phrases.compact_paths(edges)).collect()}
    assert found == {("one two three", 1, 2), ("zero two three", 1, 3), ("two three four", 1, 5), ("three four five six", 2, 2), ("three four nine", 1, 3)}


def test_empty_table(spark):
    assert phrases.collocations(table(spark, ROWS).limit(0)).collect() == []
    with pytest.raises(ValueError):
        phrases.frequent_grams(table(spark, ROWS), longest=1)

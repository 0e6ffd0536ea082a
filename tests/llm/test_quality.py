import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


@given(st.text(alphabet="ab #|\n\té ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert quality.measure(text)[:5] == brute(text)


def test_counts_of_a_long_text():
    text = "a b c d " * 20000
    assert quality.measure(text)[:5] == (80000, 80000, 0, 0, 80000)
    assert quality.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_query_counts(spark, sf):
    out = queries.op10_quality(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    for i, t in zip(docs.doc_id, docs.text):
        if len(t) < 3000:
            n, *rest = brute(t)
            assert out.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].tolist() == [n, *rest]
            assert out.loc[i, "base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)


def _corpus():
    boiler = "subscribe to our newsletter for more"
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))  # noqa: E731  (digits would be folded)
    own = lambda k: " ".join(f"w{letters(k)}x{letters(j)}" for j in range(60))
    rows = [(k, f"{own(k)}\n{boiler} {k % 10}", "host") for k in range(30)]
    rows += [(100 + k, "\n".join([f"{boiler} {k}"] * 8 + [" ".join(f"z{letters(k)}q{letters(j)}" for j in range(14))]), "host") for k in range(3)]
    rows += [(200, f"{own(200)}\n{boiler} 1", "elsewhere"), (201, None, None)]
    return rows


def test_frequent_lines(spark):
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, source string")
    out = {r.id: r for r in quality.verdicts(docs).collect()}
    assert out[0].gone is None  # the smallest id keeps the line
    assert all(out[k].gone == [1] and out[k].kept for k in range(1, 30))
    assert not out[100].kept  # depleted: most of its characters are boilerplate
    assert out[200].gone is None and out[200].kept
    assert out[201].base_failed and not out[201].kept
    cleaned = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert set(cleaned) == set(range(30)) | {200}
    assert "subscribe" in cleaned[0] and "subscribe" not in cleaned[5] and "subscribe" in cleaned[200]


def test_short_lines_count(spark):
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    menu = "\n".join(["home", "about us", "read more here"] * 30)
    rows = [(k, " ".join(f"w{letters(k)}x{letters(j)}" for j in range(60)) + "\nhome\nread more here", "host") for k in range(30)]
    rows += [(100, " ".join(f"v{letters(j)}" for j in range(60)) + f"\n{menu}", "host")] + [(200 + k, f"{menu}\nown{letters(k)}", "host") for k in range(12)]
    out = {r.id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].gone is None and all(out[k].gone == [1, 2] and out[k].kept for k in range(1, 30))
    menus = [out[200 + k] for k in range(12)]
    assert all(r.lost > 0.5 * r.word_chars and not r.kept for r in menus)
    cleaned = {r.doc_id: r.text for r in quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert "home" in cleaned[0] and "home" not in cleaned[5]


def test_equal_texts_count_as_one_document(spark):
    text = "the very same line of text here " * 3
    docs = spark.createDataFrame([(k, f"{text}\n" + " ".join(f"u{j}" for j in range(60)), "h") for k in range(40)], "doc_id long, text string, source string")
    assert quality.verdicts(docs).where("gone is not null").count() == 0


def test_edges_of_the_input(spark):
    rows = _corpus() + [_corpus()[3], (None, "a b c d", "h")]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, source string, n_words int, `key.of` string")
    assert quality.verdicts(docs).count() == len(rows)
    out = quality.cleaned(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 3").count() == 2
    assert quality.cleaned(docs.limit(0)).count() == 0

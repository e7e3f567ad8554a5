import re

import pytest

from chronoledger.llm import quality_rules as Q

from .fixtures import clashing, corpus, frame, table

ODD = ["a b c a b c", "a a a a", "one two three", "x\ny\nx\n\n \nx", "# * $ % & | < > !", "AB CD EF", "é É ß", " lead trail ", "a\u00a0b c", "w " * 500, " ".join(f"w{i % 40}" for i in range(3000))]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_are_those_of_brute_force(spark, tmp_path):
    rows = corpus() + [(9000 + i, t, None) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in Q.base_report(table(clashing(spark, rows), tmp_path)).collect()}
    for key, text, _ in rows:
        r = got[key]
        want = counts(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_order_is_by_gain_and_does_not_change_the_verdict(spark, tmp_path):
    docs = table(frame(spark, corpus()), tmp_path)
    order = Q.measure(docs)
    assert {m.name for m in order} == {r.name for r in Q.RULES}
    assert [m.gain for m in order] == sorted((m.gain for m in order), reverse=True)
    from pyspark.sql import functions as F

    body = Q.Text(F.coalesce("text", F.lit("")))
    both = docs.select(Q.cascade(body, Q.RULES, order).isNull().alias("a"), Q.cascade(body, Q.RULES, order[::-1]).isNull().alias("b")).collect()
    assert all(r.a == r.b for r in both)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.a for r in both)


def good(n=80):
    return " ".join(f"word{i} follows." for i in range(n // 2))


@pytest.mark.parametrize("name,text", [
    ("few_words", "only a few words"), ("symbols", " ".join(["ab$"] * 3 + [f"w{i}" for i in range(60)] + ["#"] * 9)), ("exclamations", " ".join(f"w{i}!" for i in range(60))),
    ("capitals", " ".join(f"W{i}ORD" for i in range(60))), ("no_letters", " ".join(str(i * 1234567) for i in range(60))), ("word_length", " ".join("ab" * 20 + str(i) for i in range(60))),
    ("dup_lines", "\n".join(["the same line again"] * 30 + [f"line w{i}" for i in range(8)])), ("repeats", " ".join(["one two three four"] * 20)),
])
def test_each_rule_rejects_its_case_and_keeps_good_text(spark, name, text):
    from pyspark.sql import functions as F

    rule = next(r for r in Q.RULES if r.name == name)
    df = spark.createDataFrame([(text,), (good(),)], "text string")
    assert [r[0] for r in df.select(rule.rejects(Q.Text(F.col("text")))).collect()] == [True, False]


def test_empty_table(spark, tmp_path):
    docs = table(frame(spark, []), tmp_path)
    assert Q.base_report(docs).count() == 0 and Q.keep_good(docs).count() == 0 and Q.judge(docs).count() == 0

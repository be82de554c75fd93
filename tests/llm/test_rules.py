import re
from collections import Counter

from songloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {p for i, x in enumerate(windows) if often[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measurements_like_counting(documents, odd_rows):
    rows = odd_rows + [
        (20, "a b c a b c a b c d"), (21, "x x x x"), (22, "a b\na b\n \na b\r\n"), (23, "#*$ |<> %&"), (24, "a\x0bb\x0cc d e"),
    ]
    got = rules.ledger(documents(rows, extra=True)).collect()
    want = sorted(((i, *plain(t)) for i, t in rows), key=repr)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == want
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert base == bool(r.failed & rules.mask(rules.BASE))


def test_policies_and_ablations(spark):
    masks = [0, 1, 1, 2, 3, 4, 6]
    ledger = spark.createDataFrame([(m,) for m in masks], "failed long")
    for policy, members in rules.POLICIES.items():
        kept = ledger.where(rules.kept_under(members)).count()
        assert kept == sum(m & rules.mask(members) == 0 for m in masks), policy
    rows = {(r.policy, r.rule): (r.failing, r.only) for r in rules.ablations(ledger).collect()}
    assert rows["base", "few_words"] == (3, 2)
    assert rows["base", "repeated_words"] == (3, 2)
    assert rows["2024-01", "symbols"] == (2, 1)
    assert rows["2024-01", "repeated_words"] == (3, 1)


def test_native_plan_and_empty_table(documents):
    df = rules.ledger(documents([(1, "a")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert rules.ledger(documents([(1, "a")]).limit(0)).count() == 0
